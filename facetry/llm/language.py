"""Language identification by error-correcting output codes over letter n-grams."""

from __future__ import annotations

import sys
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from facetry.llm.texts import bucket_of, checkpointed, id_type, keyed, map_rows

BITS = 14
SLOTS = 1 << BITS
CHUNK = 1024
#: Characters handled at once, so that a very long text takes bounded memory.
PIECE = 1 << 20
#: Languages whose counts a task holds before it hands them on, and whose codes are compared with each other.
HELD, COMPARED = 200, 500
UNKNOWN = "und"
#: A decoding whose two nearest codewords differ by less than this share of their probability is ambiguous.
AMBIGUOUS = 0.2


@cache
def letters() -> np.ndarray:
    return np.fromiter((chr(c).isalpha() for c in range(sys.maxunicode + 1)), bool, sys.maxunicode + 1)


def points_of(text: str) -> np.ndarray:
    """The code points of the lower-cased text, all but letters as spaces."""
    points = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    return np.where(letters()[points], points, 32).astype(np.uint32)


def single_spaced(points: np.ndarray) -> np.ndarray:
    return points[np.append(True, (points[1:] != 32) | (points[:-1] != 32))]


def slots_ending_after(points: np.ndarray, seen: int) -> np.ndarray:
    """The hash slots of all sequences of one to three points that end after the first ``seen`` (one or two) of them."""
    pairs = points[:-1] * np.uint32(2654435761) + points[1:]
    triples = pairs[:-1] * np.uint32(2246822519) + points[2:]
    new = points[seen:]
    hashed = np.concatenate([new[new != 32] * np.uint32(3266489917), pairs[seen - 1 :] * np.uint32(668265263), triples[max(seen - 2, 0) :]])
    hashed ^= hashed >> np.uint32(15)
    return ((hashed * np.uint32(2654435769)) >> np.uint32(32 - BITS)).astype(np.int32)


def slots_of(text: str) -> np.ndarray | None:
    """The hash slots of all one- to three-character sequences of lower-cased letters and word bounds; None without a letter."""
    points = single_spaced(np.concatenate([[32], points_of(text), [32]]).astype(np.uint32))
    return slots_ending_after(points, 1) if len(points) >= 3 else None


def cut(text: str, size: int):
    """Pieces of the text of up to ``size`` characters, each cut behind a space if it has one, as a letter's lower case can depend on its word."""
    start = 0
    while start < len(text):
        end = start + size
        if end < len(text):
            end = text.rfind(" ", start, end) + 1 or end
        yield text[start:end]
        start = end


def counts_of(text: str) -> np.ndarray | None:
    """Counts of ``slots_of`` piece by piece, the last two characters of each carried over to the next; None without a letter."""
    if len(text) <= PIECE:
        found = slots_of(text)
        return None if found is None else np.bincount(found, minlength=SLOTS)
    total, last, found = np.zeros(SLOTS, np.int64), np.array([32], np.uint32), False
    for piece in (*cut(text, PIECE), " "):
        points = single_spaced(np.concatenate([last, points_of(piece)]))
        if len(points) > len(last):
            total += np.bincount(slots_ending_after(points, len(last)), minlength=SLOTS)
            found = True
        last = points[-2:]
    return total if found else None


def language_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """``lang``, ``chunk``, ``counts``, ``total``: the slot counts over all texts of each language, a row for each chunk of slots, their sum beside it.

    Rows without a language, and languages without a letter in any text, teach nothing.
    """
    rows = keyed(docs.where(F.col(f"`{lang_col}`").isNotNull()), id_col, text_col, lang=F.col(f"`{lang_col}`").cast("string"))

    def make():
        total: dict[str, np.ndarray] = {}

        def hand_on():
            keys = [(x, i) for x in total for i in range(SLOTS // CHUNK)]
            out = {"lang": [x for x, _ in keys], "chunk": [i for _, i in keys], "counts": [total[x][i * CHUNK : (i + 1) * CHUNK].astype("<i8").tobytes() for x, i in keys], "total": [0] * len(keys)}
            total.clear()
            return out

        def each(batch):
            for raw, lang in zip(batch["text"].to_pylist(), batch["lang"].to_pylist(), strict=True):
                if raw and (found := counts_of(raw.decode("utf-8", "replace"))) is not None:
                    total[lang] = total[lang] + found if lang in total else found
            return hand_on() if len(total) > HELD else None

        each.finish = lambda: hand_on() if total else None
        return each

    def summed(key, table):
        found = np.sum([np.frombuffer(x, "<i8") for x in table["counts"].to_pylist()], axis=0)
        return pa.table({"lang": [key[0].as_py()], "chunk": pa.array([key[1].as_py()], pa.int32()), "counts": pa.array([found.tobytes()], pa.binary()), "total": pa.array([int(found.sum())], pa.int64())})

    kind = "lang string, chunk int, counts binary, total long"
    return map_rows(rows, make, kind).groupBy("lang", "chunk").applyInArrow(summed, kind)


def fit_codes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> OutputCodes:
    """The classifiers of all languages' codewords.

    Counts by language stay in Spark: each bit's two sides are summed there, slot by slot, so that the driver gets the languages' names and
    two numbers a slot and bit. Codewords have about as many bits as ten times the logarithm of the number of languages.
    """
    counts = checkpointed(language_counts(docs, id_col, text_col, lang_col))
    totals = {r.lang: r.total for r in counts.groupBy("lang").agg(F.sum("total").alias("total")).collect()}
    names = sorted(totals)
    code = codewords(len(names))
    on, off = np.zeros((code.shape[1], SLOTS)), np.zeros((code.shape[1], SLOTS))
    if code.shape[1]:
        shared = docs.sparkSession.sparkContext.broadcast(({x: (k, totals[x]) for k, x in enumerate(names)}, code))  # as the model itself: a codeword a language

        def make():
            numbers, code = shared.value
            sums: dict[int, np.ndarray] = {}

            def each(batch):
                for lang, chunk, raw in zip(batch["lang"].to_pylist(), batch["chunk"].to_pylist(), batch["counts"].to_pylist(), strict=True):
                    k, total = numbers[lang]
                    share = (np.frombuffer(raw, "<i8") + 0.5) / (total + 0.5 * SLOTS)
                    held = sums.setdefault(chunk, np.zeros((2, code.shape[1], CHUNK)))
                    held[0][code[k] > 0] += share
                    held[1][code[k] < 0] += share

            each.finish = lambda: {"chunk": list(sums), "sums": [x.tobytes() for x in sums.values()]} if sums else None
            return each

        def added(key, table):
            parts = np.sort([np.frombuffer(x) for x in table["sums"].to_pylist()], axis=0)
            return pa.table({"chunk": pa.array([key[0].as_py()], pa.int32()), "sums": pa.array([parts.sum(axis=0).tobytes()], pa.binary())})

        parts = map_rows(counts.select("lang", "chunk", "counts"), make, "chunk int, sums binary").groupBy("chunk").applyInArrow(added, "chunk int, sums binary")
        for r in parts.toLocalIterator():  # two numbers a slot and bit in all
            here = slice(r.chunk * CHUNK, (r.chunk + 1) * CHUNK)
            on[:, here], off[:, here] = np.frombuffer(r.sums).reshape(2, -1, CHUNK)
    return OutputCodes(names, code, on / np.maximum((code > 0).sum(axis=0), 1)[:, None], off / np.maximum((code < 0).sum(axis=0), 1)[:, None])


def codewords(n: int, seed: int = 7) -> np.ndarray:
    """A row of +1 and -1 for each of n classes: all dichotomies up to five classes, else the best of 50 random codes by least distance; of more than COMPARED classes a random one, whose words lie far apart by their length."""
    if n < 2:
        return np.ones((n, 0), np.int8)
    if n <= 5:
        columns = np.arange(1, 1 << (n - 1))
        return np.where(np.vstack([np.ones_like(columns), *((columns >> i & 1) == 0 for i in range(n - 1))]), 1, -1).astype(np.int8)
    random, best, most = np.random.default_rng(seed), None, -1
    width = 10 * int(np.ceil(np.log2(n)))
    for _ in range(50 if n <= COMPARED else 1):
        code = random.choice(np.array([-1, 1], np.int8), (n, width))
        code[random.integers(n, size=width), np.arange(width)] = -np.sign(code.sum(axis=0) + 0.5).astype(np.int8)  # no bit is the same for all
        if n > COMPARED:
            return code
        same = code.astype(np.int32) @ code.T.astype(np.int32)
        least = (width - int(same[~np.eye(n, dtype=bool)].max())) // 2
        if least > most:
            best, most = code, least
    return best


class OutputCodes:
    """Binary naive Bayes classifiers of the codewords' bits, and loss-weighted decoding."""

    def __init__(self, names: list[str], code: np.ndarray, on: np.ndarray, off: np.ndarray):
        """``on`` and ``off``: for each bit the mean share of each slot in the languages that have the bit, and in the others."""
        self.names, self.code = names, code
        self.weights = np.log(np.divide(on, off, out=np.ones_like(on), where=off > 0)).T.copy()
        self.trust = ((on - off).T * self.weights).sum(axis=0)  # how far the two sides lie apart
        self.trust = self.trust / self.trust.mean() if len(self.trust) and self.trust.sum() else np.ones(len(self.trust))

    def predict(self, text: str) -> tuple[str, float, bool]:
        """The language, a score from 0 to 1 and whether the decoding is ambiguous."""
        if len(text) <= PIECE:
            found = slots_of(text)
            if found is None or not self.names:
                return UNKNOWN, 0.0, True
            n = len(found)
            total = self.weights[found].sum(axis=0) if n < 6000 else np.bincount(found, minlength=SLOTS) @ self.weights
        else:
            counts = counts_of(text)
            if counts is None or not self.names:
                return UNKNOWN, 0.0, True
            n, total = counts.sum(), counts @ self.weights
        if len(self.names) == 1:
            return self.names[0], 1.0, False
        margin = total / np.sqrt(n)
        loss = (self.trust * np.logaddexp(0.0, -self.code * margin)).mean(axis=1)
        odds = np.exp(2.0 * (loss.min() - loss))
        odds /= odds.sum()
        order = np.argsort(-odds, kind="stable")
        return self.names[order[0]], float(odds[order[0]]), bool(odds[order[0]] - odds[order[1]] < AMBIGUOUS * odds[order[0]])


def identify(docs: DataFrame, model: OutputCodes, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``lang_pred``, ``score`` and ``ambiguous`` of each row: ``und``, 0 and true for null texts, texts without a letter, or no learned language."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # a codeword a language, and a weight a slot and bit

    def make():
        model = shared.value

        def each(batch):
            found = [model.predict(x.decode("utf-8", "replace")) if x else (UNKNOWN, 0.0, True) for x in batch["text"].to_pylist()]
            return {"doc_id": batch["doc_id"], "lang_pred": [x[0] for x in found], "score": [x[1] for x in found], "ambiguous": [x[2] for x in found]}

        return each

    return map_rows(keyed(docs, id_col, text_col), make, f"doc_id {id_type(docs, id_col)}, lang_pred string, score double, ambiguous boolean")


def held_out(id_col: str = "doc_id"):
    return F.coalesce(bucket_of(F.col(f"`{id_col}`"), 5) == 0, F.lit(False))
