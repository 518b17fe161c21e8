"""Typed tokens with offsets: an ordered alternation of rules over a text, as an array of (text, type, start, end)."""

from __future__ import annotations

from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from facetry.functions.slices import exploded, in_slices

KIND = "array<struct<text:string,type:string,start:int,end:int>>"
_ARROW = pa.struct([("text", pa.string()), ("type", pa.string()), ("start", pa.int32()), ("end", pa.int32())])


@dataclass(frozen=True)
class Rule:
    """A pattern that matches no white space, and the type of its tokens. ``needs`` is what a word must hold for the rule to be tried on it."""

    pattern: str
    type: str = ""
    needs: str = ""


# What counts as a web address, a mail address, a code, a number, a symbol and a word, tried in this order.
_LD = r"\p{L}\p{Nd}"
_PART = rf"[{_LD}][-+_{_LD}]*"
_NAME = rf"{_PART}(?:\.{_PART})*"
_RUN = rf"[-._&/{_LD}]"
ADDRESS = Rule(rf"\bhttps?://[-+&@#/%?=~_|!:,.;{_LD}]*[-+&@#/%=~_|{_LD}]", "NNP", "://")
MAIL = Rule(rf"\b{_NAME}@{_NAME}\.\p{{L}}{{2,}}\b", "NNP", "@")
#: A run of letters, digits and separators, from a letter or digit to one, with a capital that isn't the first character, or with a letter and a digit.
CODE = Rule(rf"\b(?:(?={_RUN}+\p{{Lu}})|(?={_RUN}*\p{{L}}{_RUN}*\p{{Nd}})|(?={_RUN}*\p{{Nd}}{_RUN}*\p{{L}}))(?:[{_LD}]|{_RUN}(?=\p{{Lu}})){_RUN}*[{_LD}]\b", "NNP", r"[\p{Lu}\p{Nd}]")
NUMBER = Rule(r"[-+]?(?:\d*(?:[.,]\d{3})*[.,])?\d+\b", "CD")
SYMBOL = Rule(r"[-+]?\p{S}", "SYM")
WORD = Rule(r"\b(?:\p{L}-)?\p{L}\p{Ll}*\b")
DEFAULTS = (ADDRESS, MAIL, CODE, NUMBER, SYMBOL, WORD, Rule(r"\.{3}"), Rule(r"\S"))


class Tokenizer:
    """Finds the tokens of runs without white space, which no token crosses; keeps those of runs that it met, up to ``most``."""

    def __init__(self, rules: tuple[Rule, ...] = DEFAULTS, most: int = 200_000):
        import regex

        self.rules, self.most, self.compile = rules, most, regex.compile
        self.words, self.needs = regex.compile(r"\S+"), [regex.compile(r.needs) for r in rules]
        self.patterns: dict[tuple, object] = {}
        self.known: dict[str, tuple] = {}

    def of_word(self, word: str) -> tuple[tuple[str, str, int, int], ...]:
        if (found := self.known.get(word)) is None:
            tried = tuple(i for i, (r, n) in enumerate(zip(self.rules, self.needs, strict=True)) if not r.needs or n.search(word))
            if tried not in self.patterns:
                self.patterns[tried] = self.compile("|".join(f"({self.rules[i].pattern})" for i in tried))
            found = tuple((m.group(), self.rules[tried[m.lastindex - 1]].type, m.start(), m.end()) for m in self.patterns[tried].finditer(word) if m.group()) if tried else ()
            if len(word) <= 64:
                if len(self.known) >= self.most:
                    self.known.clear()
                self.known[word] = found
        return found

    def __call__(self, text: str) -> list[tuple[str, str, int, int]]:
        return [(t, kind, m.start() + a, m.start() + b) for m in self.words.finditer(text) for t, kind, a, b in self.of_word(m.group())]

    def of_texts(self, texts: pa.Array) -> pa.ListArray:
        """The tokens of each text of a slice: each different run is told once, its tokens are then put where it stands."""
        words, starts, counts = [], [], []
        for text in texts.to_pylist():
            found = self.words.findall(text) if text else []
            words += found
            counts.append(len(found))
            if found:
                starts.append(run_starts(text))
        coded = pa.array(words, pa.string()).dictionary_encode()
        told = [self.of_word(w) for w in coded.dictionary.to_pylist()]
        flat = [t for tokens in told for t in tokens]
        sizes = np.array([len(t) for t in told], np.int64)
        code = coded.indices.to_numpy(zero_copy_only=False)
        n = sizes[code] if len(code) else np.zeros(0, np.int64)
        at = np.repeat((np.cumsum(sizes) - sizes)[code] - (np.cumsum(n) - n), n) + np.arange(n.sum()) if len(code) else np.zeros(0, np.int64)
        base = np.repeat(np.concatenate(starts), n) if starts else np.zeros(0, np.int64)
        text, kind = (pa.array([t[k] for t in flat], pa.string()).take(pa.array(at)) for k in (0, 1))
        start, end = (pa.array((base + np.array([t[k] for t in flat], np.int64)[at]).astype(np.int32)) for k in (2, 3))
        ends = np.cumsum(np.concatenate([[0], n]))[np.cumsum([0, *counts])].astype(np.int32)
        return pa.ListArray.from_arrays(pa.array(ends), pa.StructArray.from_arrays([text, kind, start, end], fields=list(_ARROW)), mask=texts.is_null())


@cache
def spaces() -> np.ndarray:
    """Whether a code point is white space, as the patterns know it; none above has the value of the last."""
    import regex

    return np.array([not 0xD800 <= c < 0xE000 and bool(regex.match(r"\s", chr(c))) for c in range(0x10001)])


def run_starts(text: str) -> np.ndarray:
    """Where the runs without white space of a text start."""
    points = np.frombuffer(text.encode("utf-32-le"), np.uint32)
    inside = ~spaces()[np.minimum(points, 0x10000)]
    return np.flatnonzero(inside & np.concatenate([[True], ~inside[:-1]]))


def typed_tokens(text: Column, rules: tuple[Rule, ...] = DEFAULTS) -> Column:
    """The tokens of a text by the first rule that matches at each place, from the left; ``text`` is the slice from ``start`` to ``end``, in code points.

    A null text has null tokens, an empty one none. Rules can't have groups of their own. All tokens of a batch of rows are held at once; ``token_rows`` holds those of a slice.
    """
    return F.arrow_udf(lambda texts: in_slices(texts, Tokenizer(rules).of_texts), KIND)(text)


def token_rows(rows: DataFrame, keep: list[str], text: Column, at: str | None = None, rules: tuple[Rule, ...] = DEFAULTS) -> DataFrame:
    """A row for each token (of ``typed_tokens``): the columns to keep, its number (``at``, if named), ``text``, ``type``, ``start``, ``end``."""
    return exploded(rows, keep, text, Once(lambda: Tokenizer(rules).of_texts), KIND, at)


class Once:
    """A function that is made where and when it is first called."""

    def __init__(self, make):
        self.make, self.made = make, None

    def __call__(self, *values):
        if self.made is None:
            self.made = self.make()
        return self.made(*values)


def chunk_text(tokens: Column) -> Column:
    """The text of a run of tokens: a space where there is a gap between two."""
    after = F.transform(tokens, lambda t, i: F.concat(F.when((i > 0) & (F.get(tokens, i - 1)["end"] < t["start"]), " ").otherwise(""), t["text"]))
    return F.array_join(after, "")


def normal(word: Column) -> Column:
    """Words that differ in case only are one."""
    return F.lower(word)
