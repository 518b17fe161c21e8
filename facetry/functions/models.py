"""Models of token runs: combinators that tell, for each place of a run of tokens, how many tokens match there.

A model has no choices to take back: a sequence takes what each part takes, repetition takes all that it can, alternatives the longest.
So each node of a model is one array over all places of a batch of texts, computed from its parts' arrays.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from facetry.functions.slices import exploded
from facetry.functions.tokens import Once, Tokenizer

NONE = -1
FOUND = "array<struct<type:string,first:int,words:int,start:int,end:int>>"
_ARROW = pa.struct([("type", pa.string()), ("first", pa.int32()), ("words", pa.int32()), ("start", pa.int32()), ("end", pa.int32())])


@dataclass(frozen=True)
class Tokens:
    """The tokens of a batch, one text after the other, each text with a place after its last token, where nothing matches."""

    texts: list[str | None]
    types: list[str | None]

    def where(self, test: Test) -> np.ndarray:
        known: dict[tuple, bool] = {}
        return np.fromiter((known[x] if x in known else known.setdefault(x, x[0] is not None and test(*x)) for x in zip(self.texts, self.types, strict=True)), bool, len(self.texts))


@dataclass(frozen=True)
class Coded:
    """``Tokens`` as arrays: for each place which of the ``known`` (text, type) stands there."""

    codes: np.ndarray
    known: list[tuple[str | None, str | None]]

    def where(self, test: Test) -> np.ndarray:
        return np.fromiter((x[0] is not None and test(*x) for x in self.known), bool, len(self.known))[self.codes]


def tokens_at(flat: pa.StructArray, slots: np.ndarray, n: int) -> Coded:
    """Tokens put at n places; nothing stands at the others."""
    text, kind = (flat.field(f).dictionary_encode() for f in ("text", "type"))
    code = lambda x: x.indices.fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64) + 1
    width = len(kind.dictionary) + 1
    pairs, codes = np.unique(code(text) * width + code(kind), return_inverse=True)
    texts, kinds = [None, *text.dictionary.to_pylist()], [None, *kind.dictionary.to_pylist()]
    out = np.zeros(n, np.int64)
    out[slots] = codes + 1
    return Coded(out, [(None, None), *((texts[p // width], kinds[p % width]) for p in pairs.tolist())])


Test = Callable[[str, str], bool]


@dataclass(frozen=True)
class Model:
    """``lengths`` gives for each place the count of tokens that match there, 0 for a match of none, NONE for no match."""

    lengths: Callable[[Tokens | Coded], np.ndarray]

    def __add__(self, other: Model) -> Model:
        """One, then the other."""

        def lengths(tokens):
            first, then = self.lengths(tokens), other.lengths(tokens)
            after = then[np.arange(len(first)) + np.maximum(first, 0)]
            return np.where((first >= 0) & (after >= 0), first + after, NONE)

        return Model(lengths)

    def __or__(self, other: Model) -> Model:
        """The longer of both."""
        return Model(lambda tokens: np.maximum(self.lengths(tokens), other.lengths(tokens)))

    def optional(self) -> Model:
        return Model(lambda tokens: np.maximum(self.lengths(tokens), 0))

    def repeated(self, least: int = 0) -> Model:
        """As often as it matches some tokens, ``least`` (0 or 1) times at least."""

        def lengths(tokens):
            one = self.lengths(tokens)
            here = np.arange(len(one))
            to = here + np.maximum(one, 0)
            while (further := to[to]) is not to and (further != to).any():  # twice as many at each step
                to = further
            return np.where((one < 0) & (least > 0) | (to == here) & (least > 0), NONE, to - here)

        return Model(lengths)

    def ahead(self) -> Model:
        """Matches no tokens where this matches."""
        return Model(lambda tokens: np.where(self.lengths(tokens) >= 0, 0, NONE))

    def __invert__(self) -> Model:
        """Matches no tokens where this doesn't match."""
        return Model(lambda tokens: np.where(self.lengths(tokens) >= 0, NONE, 0))

    def counted(self, test: Test, fits: Callable[[np.ndarray, np.ndarray], np.ndarray]) -> Model:
        def lengths(tokens):
            n, sums = self.lengths(tokens), np.concatenate([[0], np.cumsum(tokens.where(test))])
            hits = sums[np.arange(len(n)) + np.maximum(n, 0)] - sums[: len(n)]
            return np.where((n > 0) & fits(hits, n), n, NONE)

        return Model(lengths)

    def every(self, test: Test) -> Model:
        """Matches where this matches tokens that all pass a test."""
        return self.counted(test, lambda hits, n: hits == n)

    def some(self, test: Test) -> Model:
        return self.counted(test, lambda hits, n: hits > 0)

    def none(self, test: Test) -> Model:
        return self.counted(test, lambda hits, n: hits == 0)


def token(test: Test) -> Model:
    """One token that passes a test of its text and type."""
    return Model(lambda tokens: np.where(tokens.where(test), 1, NONE))


def typed(*types: str) -> Test:
    """A token of one of the types, or of any but none."""
    return lambda text, kind: kind in types if types else bool(kind)


def upper(text: str, kind: str) -> bool:
    return text[:1].isupper()


def lower(text: str, kind: str) -> bool:
    return text[:1].islower()


def among(*words: str) -> Test:
    """A token that is one of the words, whatever its case."""
    known = {w.lower() for w in words}
    return lambda text, kind: text.lower() in known


def model_matches(tokens: Column, model: Model, kind: str = "") -> Column:
    """The model's matches in an array of typed tokens, from the left, none overlapping: type, number of the first token, count, and offsets. Null for null."""
    return F.arrow_udf(lambda batch: matches_of(batch, model, kind), FOUND)(tokens)


def model_rows(rows: DataFrame, keep: list[str], text: Column, model: Model, kind: str = "") -> DataFrame:
    """A row for each match (of ``model_matches``) in the typed tokens of a text: the columns to keep, ``type``, ``first``, ``words``, ``start``, ``end``. Tokens stay in the task, those of a slice at once."""
    return exploded(rows, keep, text, Once(lambda: tokens_then(lambda tokens: matches_of(tokens, model, kind))), FOUND)


def tokens_then(run: Callable[[pa.Array], pa.Array]) -> Callable[[pa.Array], pa.Array]:
    tokenizer = Tokenizer()
    return lambda texts: run(tokenizer.of_texts(texts))


def matches_of(batch: pa.Array, model: Model, kind: str) -> pa.Array:
    sizes = np.asarray(batch.value_lengths().fill_null(0), np.int64)
    flat = batch.flatten()
    ends = np.cumsum(sizes)
    slots = np.arange(len(flat)) + np.repeat(np.arange(len(sizes)), sizes)  # a free place after each text
    found = model.lengths(tokens_at(flat, slots, len(flat) + len(sizes) + 1))
    starts, stops = (flat.field(f).to_numpy(zero_copy_only=False) for f in ("start", "end"))
    owner = np.repeat(np.arange(len(sizes) + 1), np.append(sizes + 1, 1))
    places, free = [], 0
    hits = np.flatnonzero(found > 0)
    for at, n in zip(hits.tolist(), found[hits].tolist(), strict=True):
        if at >= free:
            places.append(at)
            free = at + n
    at = np.array(places, np.int64)
    of, n = owner[at], found[at].astype(np.int64)
    base = at - of
    first = base - (ends - sizes)[of] if len(sizes) else base
    numbers = (pa.array(x.astype(np.int32)) for x in (first, n, starts[base], stops[base + n - 1]))
    offsets = pa.array(np.concatenate([[0], np.cumsum(np.bincount(of, minlength=len(sizes)))]).astype(np.int32))
    return pa.ListArray.from_arrays(offsets, pa.StructArray.from_arrays([pa.array([kind] * len(at), pa.string()), *numbers], fields=list(_ARROW)), mask=batch.is_null())


def ngrams(tokens: Column, least: int, most: int) -> Column:
    """Runs of ``least`` to ``most`` tokens that begin with a capital or a noun and end with one or a number, as ``model_matches`` gives them; they may overlap. The tokens are a column of their own, as functions of arrays take no Python function."""
    nouns = ("NN", "NNS", "NNP", "NNPS")
    head = lambda t: t["text"].rlike(r"^\p{Lu}") | t["type"].isin(*nouns)
    tail = lambda t: head(t) | (t["type"] == "CD")
    at = F.when(F.size(tokens) > 0, F.sequence(F.lit(0), F.size(tokens) - 1)).otherwise(F.array().cast("array<int>"))

    def runs(i: Column) -> Column:
        ends = F.transform(F.sequence(F.lit(max(least, 1)), F.lit(most)), lambda n: i + n)
        fit = F.filter(ends, lambda e: (e <= F.size(tokens)) & tail(F.get(tokens, e - 1)))
        run = F.transform(fit, lambda e: F.struct(F.lit("").alias("type"), i.alias("first"), (e - i).alias("words"), F.get(tokens, i)["start"].alias("start"), F.get(tokens, e - 1)["end"].alias("end")))
        return F.when(head(F.get(tokens, i)), run).otherwise(F.slice(run, 1, 0))

    return F.flatten(F.transform(at, runs))
