"""Suffix-array dedup: passages that occur elsewhere, by longest previous factors in suffix order.

A corpus has too many suffixes for one order. Windows (the strings sought, of fixed length) are dealt by the least hash of
their k-grams: equal windows have equal least hashes, so each part can be put in suffix order on its own. Neighbouring windows
of a text mostly share the least k-gram, and form a run, one row of the shuffle. Runs that are equal as a whole are summed
before they are shuffled, and the first of them stands for all. Only different runs of one k-gram send their bytes: these
are put in suffix order, and the previous and next smaller positions in it give each window's longest previous factor.
"""

from __future__ import annotations

import hashlib
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from facetry.llm.texts import checkpointed, id_type, map_rows, numbered, record_batch, release

LENGTH = 400
#: Length of the k-grams whose least hash deals windows out.
GRAM = 48
#: Bytes handled at once; bytes of a k-gram's spans that are sorted in one task at most; bytes of spans sorted at once.
PIECE, HOT, SORT = 1 << 19, 1 << 20, 1 << 19
#: Pairs of suffixes whose common prefixes are told at once.
SLICE = 1 << 16
#: A run that makes up more than this share of all runs is common: there are fewer than 1 / COMMON of those.
COMMON = 1 / 2000
#: Bytes by which suffixes are first ranked; each further round doubles the length.
FIRST = 7
_M1, _M2 = np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53)


@cache
def powers(n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A random number for each byte, and n powers of an odd base and of its inverse, modulo 2 ** 64."""
    base = 0x9E3779B97F4A7C15
    with np.errstate(over="ignore"):
        up, down = (np.multiply.accumulate(np.append(np.uint64(1), np.full(n - 1, b, np.uint64))) for b in (base, pow(base, -1, 1 << 64)))
    return np.random.default_rng(17).integers(1 << 63, size=256, dtype=np.uint64) * np.uint64(2) + np.uint64(1), up, down


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(33))) * _M1
    x = (x ^ (x >> np.uint64(29))) * _M2
    return x ^ (x >> np.uint64(32))


class Hashes:
    """Hashes of all substrings of a buffer, from sums of powers."""

    def __init__(self, buffer: np.ndarray):
        value, up, self.down = powers(max(1 << 20, 1 << len(buffer).bit_length()))  # few sizes, as they are kept
        self.sums = np.zeros(len(buffer) + 1, np.uint64)
        np.cumsum(value[buffer] * up[: len(buffer)], out=self.sums[1:])

    def all(self, length: int) -> np.ndarray:
        n = len(self.sums) - length
        return mixed((self.sums[length:] - self.sums[:n]) * self.down[:n])


def sliding_least(x: np.ndarray, width: int) -> np.ndarray:
    """The least of each ``width`` neighbours, from running minima to both sides of every ``width``-th place."""
    n = len(x) - width + 1
    blocks = np.full(-(-len(x) // width) * width, np.iinfo(np.uint64).max, np.uint64)
    blocks[: len(x)] = x
    blocks = blocks.reshape(-1, width)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    back = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(back[:n], ahead[width - 1 : width - 1 + n])


def window_runs(texts: list[bytes], length: int = LENGTH, gram: int = GRAM) -> dict[str, np.ndarray] | None:
    """Runs of windows of the joined texts: text number, first window, number of windows, least k-gram hash, 128 bits of hash of the run's bytes, and whether a k-gram of that hash recurs in the text."""
    joined = b"".join(texts)
    buffer = np.frombuffer(joined, np.uint8)
    ends = np.cumsum([len(t) for t in texts])
    starts = ends - [len(t) for t in texts]
    if len(buffer) < length:
        return None
    hashes = Hashes(buffer)
    grams = hashes.all(gram)
    least = sliding_least(grams, length - gram + 1)
    bound = np.zeros(len(least) + 1, bool)
    bound[1:-1] = least[1:] != least[:-1]
    bound[starts[starts < len(bound)]] = True
    bound[np.maximum(ends - length + 1, 0)[(ends - length + 1) < len(bound)]] = True
    bound[0] = bound[-1] = True
    at = np.flatnonzero(bound)
    first, n = at[:-1], np.diff(at)
    text = np.searchsorted(starts, first, side="right") - 1
    while (empty := ends[text] <= first).any():  # starts shared with empty texts
        text[empty] += 1
    ok = first <= ends[text] - length
    first, n, text = first[ok], n[ok], text[ok]
    if not len(first):
        return None
    h = least[first]
    rare = np.flatnonzero(grams <= h.max())
    owner = (np.searchsorted(starts, rare, side="right") - 1).astype(np.uint64)
    seen = np.sort(mixed(grams[rare] + owner * _M1))
    own = mixed(h + text.astype(np.uint64) * _M1)
    again = np.searchsorted(seen, own, side="right") - np.searchsorted(seen, own, side="left") > 1
    whole = digests(joined, first, first + n + length - 1)
    return {"text": text, "lo": first - starts[text], "n": n, "h": h.view(np.int64), "s1": whole[:, 0], "s2": whole[:, 1], "again": again & (n > 1)}


def digests(text: bytes, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """128 bits of hash of each of the substrings, as two longs."""
    from xxhash import xxh3_128_digest

    view = memoryview(text)
    return np.frombuffer(b"".join([xxh3_128_digest(view[a:b]) for a, b in zip(starts.tolist(), ends.tolist(), strict=True)]), np.int64).reshape(-1, 2)


def pieces_of(texts: list[bytes | None], length: int = LENGTH):
    """Groups of (row, offset, bytes) of about PIECE bytes; a longer text is cut, with an overlap, so that each window is in one piece."""
    group, size = [], 0
    for i, t in enumerate(texts):
        for at in range(0, max(0, len(t or b"") - length + 1), PIECE):
            part = t[at : at + PIECE + length - 1]
            if group and size + len(part) > PIECE:
                yield group
                group, size = [], 0
            group.append((i, at, part))
            size += len(part)
    if group:
        yield group


def text_runs(docs: DataFrame, length: int) -> DataFrame:
    def make():
        def each(batch):
            found = []
            for group in pieces_of(batch["text"].to_pylist(), length):
                if (r := window_runs([p for _, _, p in group], length, min(GRAM, length))) is not None:
                    row, offset = np.array([g[0] for g in group]), np.array([g[1] for g in group])
                    found.append({"row": row[r["text"]], "lo": r["lo"] + offset[r["text"]]} | {k: r[k] for k in ("n", "h", "s1", "s2", "again")})
            if not found:
                return None
            out = {k: np.concatenate([f[k] for f in found]) for k in found[0]}
            row = pa.array(out.pop("row"))
            return out | {k: batch[k].take(row) for k in ("doc_id", "k1", "k2")}

        return each

    return map_rows(docs.select("doc_id", "k1", "k2", "text"), make, f"doc_id {id_type(docs, 'doc_id')}, k1 long, k2 long, lo long, n long, h long, s1 long, s2 long, again boolean")


class Suffixes:
    """The suffixes of spans that are windows or longer, in suffix order to a depth of at least ``length`` bytes.

    Those that share less than ``least`` bytes (the greatest ranked depth up to the length) with any other are left out.

    Suffixes are ranked by their first bytes, then by twice as many in each round, until the depth is reached or all differ.
    Two suffixes have the same rank of a round exactly if they agree in all its bytes, so that ranks tell common prefixes.
    """

    def __init__(self, spans: list[bytes], length: int):
        size = np.array([len(s) for s in spans], np.int64)
        ends = np.cumsum(size)
        buffer = np.frombuffer(b"".join(spans) + bytes(8), np.uint8)
        n = int(ends[-1])
        self.end = np.repeat(ends, size).astype(np.int32)
        left = np.minimum(self.end - np.arange(n, dtype=np.int32), FIRST).astype(np.uint8)
        self.key = np.zeros(n, np.uint64)
        for k in range(FIRST):
            self.key |= np.where(left > k, buffer[k : n + k], 0)
            self.key <<= np.uint64(8)
        self.key |= left
        order = np.argsort(self.key, kind="stable").astype(np.int32)
        first, tied = equals(self.key[order], np.arange(n, dtype=np.int32))
        rank = np.empty(n, np.int32)
        rank[order] = first
        self.depths, self.ranks = [FIRST], [rank]
        while self.depths[-1] < length and len(tied):
            d, at = self.depths[-1], order[tied]
            by = rank[at].astype(np.int64)
            by *= n + 1
            by += np.where(at + d < self.end[at], rank[np.minimum(at + d, n - 1)] + 1, 0)
            again = np.argsort(by, kind="stable")
            order[tied] = at[again]
            by = by[again]
            del at, again
            first, more = equals(by, tied)
            rank = rank.copy()
            rank[order[tied]] = first
            tied = tied[more]
            self.depths.append(2 * d)
            self.ranks.append(rank)
        ranked = len([d for d in self.depths if d <= length])
        self.starts = np.flatnonzero(self.end - np.arange(n, dtype=np.int32) >= length)
        chosen = np.zeros(n, bool)
        chosen[self.starts] = True
        if ranked:
            chosen &= np.bincount(self.ranks[ranked - 1], minlength=n)[self.ranks[ranked - 1]] > 1
        self.order, self.least = order[chosen[order]], self.depths[ranked - 1] if ranked else 0

    def common(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The common prefixes of suffixes, in bytes; those deeper than the order are told as its depth, those of less than ``least`` bytes as 0."""
        if not self.least:
            return self._common(a, b)
        rank = self.ranks[self.depths.index(self.least)]
        out, some = np.zeros(len(a), np.int64), np.flatnonzero(rank[a] == rank[b])
        out[some] = self._common(a[some], b[some])
        return out

    def _common(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        i, j, total, limit = a, b, np.zeros(len(a), np.int64), np.minimum(self.end[a] - a, self.end[b] - b)
        last = len(self.end) - 1
        for d, rank in zip(self.depths[::-1], self.ranks[::-1], strict=True):
            same = (total < limit) & (rank[np.minimum(i, last)] == rank[np.minimum(j, last)])
            i, j, total = i + d * same, j + d * same, total + d * same
        other, same = self.key[np.minimum(i, last)] ^ self.key[np.minimum(j, last)], total < limit
        for k in range(FIRST):
            same = same & (other >> np.uint64(8 * (FIRST - k)) & np.uint64(255) == 0)
            total = total + same
        return np.minimum(total, limit)


def equals(keys: np.ndarray, places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For sorted keys at these places: the first place of each one's equals, and which of them have any."""
    new = np.append(True, keys[1:] != keys[:-1])[: len(keys)]
    starts = np.flatnonzero(new)
    return np.repeat(places[starts], np.diff(np.append(starts, len(keys)))), np.flatnonzero(~(new & np.append(new[1:], True)[: len(keys)])).astype(np.int32)


def nearest_smaller(x: np.ndarray) -> np.ndarray:
    """For each place the nearest one before it with a smaller value, or -1: pointers jump over greater values, all side by side at first."""
    at = np.arange(len(x)) - 1
    todo = np.arange(len(x))
    for _ in range(400):
        todo = todo[(at[todo] >= 0) & (x[at[todo]] > x[todo])]
        if not len(todo):
            return at
        at[todo] = at[at[todo]]
    jumps, values = at.tolist(), x.tolist()
    for i in todo.tolist():  # in order, so that what lies before has its last pointer and is jumped over once
        k = jumps[i]
        while k >= 0 and values[k] > values[i]:
            k = jumps[k]
        jumps[i] = k
    return np.array(jumps)


def longest_factors(suffixes: Suffixes, later: bool = False) -> np.ndarray:
    """For each window, in order of position, its longest previous factor: the greater of the common prefixes with the previous and the next smaller position in suffix order. ``later``: with greater positions, the longest next factor."""
    order = suffixes.order
    position = -order if later else order
    before, after = nearest_smaller(position), len(order) - 1 - nearest_smaller(position[::-1])[::-1]
    number, found = np.empty(len(suffixes.end), np.int64), np.zeros(len(order), np.int64)
    for other in (before, after):
        there = np.flatnonzero((other >= 0) & (other < len(order)))
        for k in range(0, len(there), SLICE):  # what is compared at once needs ten times its bytes
            ok = there[k : k + SLICE]
            found[ok] = np.maximum(found[ok], suffixes.common(order[ok], order[other[ok]]))
    number[suffixes.starts] = np.arange(len(suffixes.starts))
    out = np.zeros(len(suffixes.starts), np.int64)
    out[number[order]] = found
    return out


def repeated_windows(spans: list[bytes], first_stays: bool, length: int = LENGTH) -> np.ndarray:
    """For all windows of all spans, one after the other, whether the window goes: its string occurs elsewhere (or, earlier)."""
    suffixes = Suffixes(spans, length)
    goes = longest_factors(suffixes) >= length
    return goes if first_stays else goes | (longest_factors(suffixes, later=True) >= length)


def flagged(goes: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Runs of flagged windows within spans of so many windows: span number, first window, number of windows."""
    span = np.repeat(np.arange(len(counts)), counts)
    inside = np.arange(len(goes)) - np.repeat(np.cumsum(counts) - counts, counts)
    start = np.flatnonzero(goes & np.append(True, ~goes[:-1] | (span[1:] != span[:-1])))
    stop = np.flatnonzero(goes & np.append(~goes[1:] | (span[1:] != span[:-1]), True))
    return span[start], inside[start], stop - start + 1


RANGES = "k1 long, k2 long, s long, e long"


def slices_of(batch: pa.RecordBatch, most: int):
    """Slices of a batch whose spans have ``most`` bytes or less together, or one row."""
    ends, at = np.cumsum(pc.binary_length(batch["span"]).to_numpy(zero_copy_only=False)), 0
    while at < batch.num_rows:
        end = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + most, side="right")))
        yield batch.slice(at, end - at), int(ends[end - 1] - (ends[at - 1] if at else 0))
        at = end


def whole_grams(batches):
    """Tables of all spans of one or more k-grams, from spans sorted by k-gram: about SORT bytes, or one k-gram's."""
    held: list[pa.RecordBatch] = []
    size = 0
    for batch in batches:
        for part, n in slices_of(batch, SORT // 8):
            held.append(part)
            size += n
            if size >= SORT:
                rows = pa.Table.from_batches(held)
                h = rows["h"].to_numpy()
                if whole := int(np.searchsorted(h, h[-1])):  # the last k-gram may go on
                    yield rows.slice(0, whole)
                    held = rows.slice(whole).combine_chunks().to_batches()
                    size = sum(pc.sum(pc.binary_length(x["span"])).as_py() for x in held)
    if held:
        yield pa.Table.from_batches(held)


def sort_spans(first_stays: bool, length: int):
    """Over spans that come sorted by k-gram and position: the byte ranges that windows repeated within a k-gram's spans cover."""

    def run(batches):
        kind = pa.schema([(k, pa.int64()) for k in ("k1", "k2", "s", "e")])
        for rows in whole_grams(batches):
            spans = rows["span"].to_pylist()
            counts = np.array([len(s) - length + 1 for s in spans])
            span, lo, n = flagged(repeated_windows(spans, first_stays, length), counts)
            s = rows["lo"].to_numpy()[span] + lo
            yield record_batch({"k1": rows["k1"].to_numpy()[span], "k2": rows["k2"].to_numpy()[span], "s": s, "e": s + n + length - 1}, kind)
        release()

    return run


def each_window(length: int):
    """Rows (128 bits of hash, position) of all windows of spans, for k-grams with too many spans for one task."""

    def run(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                part = batch.slice(i, 1)
                span = part["span"][0].as_py()
                for k in range(0, len(span) - length + 1, 1 << 16):
                    at = np.arange(k, min(k + (1 << 16), len(span) - length + 1))
                    hashed = digests(span, at, at + length)
                    row = pa.array(np.zeros(len(at), np.int64))
                    yield pa.RecordBatch.from_arrays([pa.array(hashed[:, 0]), pa.array(hashed[:, 1]), *(part[c].take(row) for c in ("doc_id", "k1", "k2")), pa.array(at + part["lo"][0].as_py())], ["w1", "w2", "doc_id", "k1", "k2", "at"])

    return run


def compressed(docs: DataFrame, carry: tuple[str, ...] = ()) -> DataFrame:
    """The texts compressed, as they are dealt out twice; null texts are empty."""

    def make():
        import zstandard

        pack = zstandard.ZstdCompressor(level=1)
        return lambda batch: {"packed": [pack.compress(t or b"") for t in batch["text"].to_pylist()]} | {k: batch[k] for k in ("doc_id", "k1", "k2", *carry)}

    kinds = "".join(f", {c} {docs.schema[c].dataType.simpleString()}" for c in carry)
    return map_rows(docs.select("doc_id", "k1", "k2", "text", *carry), make, f"doc_id {id_type(docs, 'doc_id')}, k1 long, k2 long, packed binary{kinds}")


def spans_of(docs: DataFrame, needed: DataFrame, length: int) -> DataFrame:
    """The bytes of the runs that must be sorted."""
    lists = needed.groupBy("k1", "k2").agg(F.collect_set(F.struct("lo", "n", "h", "hot")).alias("runs"))

    def make():
        import zstandard

        unpack = zstandard.ZstdDecompressor()

        def each(batch):
            out: dict[str, list] = {k: [] for k in ("row", "lo", "h", "hot", "span")}
            for i, (t, found) in enumerate(zip(batch["packed"].to_pylist(), batch["runs"].to_pylist(), strict=True)):
                text = unpack.decompress(t)
                for r in found:
                    for k, v in (("row", i), ("lo", r["lo"]), ("h", r["h"]), ("hot", r["hot"]), ("span", text[r["lo"] : r["lo"] + r["n"] + length - 1])):
                        out[k].append(v)
            row = pa.array(out.pop("row"), pa.int64())
            return out | {k: batch[k].take(row) for k in ("doc_id", "k1", "k2")}

        return each

    # rows that repeat an identifier and a text would send the same spans again
    texts = compressed(docs).join(lists, ["k1", "k2"]).select("doc_id", "k1", "k2", "packed", "runs")
    return map_rows(texts, make, f"doc_id {id_type(docs, 'doc_id')}, k1 long, k2 long, lo long, h long, hot boolean, span binary")


def keyed_texts(docs: DataFrame, id_col: str, text_col: str, first_stays: bool, carry: tuple[str, ...] = ()) -> DataFrame:
    """Two keys name a row: hashes of its identifier with its text, and of its text; or, where rows that are equal in both differ in what they lose, its number in a written table, and 0."""
    if first_stays:
        table = numbered(docs)
        of = F.col("of").getField
        return table.select(of(id_col).alias("doc_id"), F.col("row").alias("k1"), F.lit(0).cast("long").alias("k2"), of(text_col).cast("string").cast("binary").alias("text"), *(of(c).alias(f"row_{i}") for i, c in enumerate(carry)))
    text = F.col(f"`{text_col}`").cast("string")
    return docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.xxhash64(F.col(f"`{id_col}`"), text, F.lit("row")).alias("k1"), F.xxhash64(text, F.lit("text")).alias("k2"), text.cast("binary").alias("text"), *(F.col(f"`{c}`").alias(f"row_{i}") for i, c in enumerate(carry)))


def repeated_runs(rows: DataFrame, classes: DataFrame, first_stays: bool) -> DataFrame:
    """Runs of which an equal one is elsewhere (or, earlier). Common ones, few by their definition, are sent to all tasks; of the others none is large."""
    names, total = ["h", "s1", "s2"], rows.count()
    twice = classes.where("n_runs > 1").select(*names, "n_runs", "first")
    common = F.col("n_runs") > max(1000.0, total * COMMON)
    few, many = twice.where(common).drop("n_runs"), twice.where(~common).drop("n_runs")
    found = rows.join(many, names) if few.isEmpty() else rows.join(many, names).union(rows.join(F.broadcast(few), names))
    place = F.struct("doc_id", "k1", "lo")
    return found.where(~place.eqNullSafe(F.col("first").dropFields("k2", "n"))) if first_stays else found


def repeated_ranges(docs: DataFrame, first_stays: bool, length: int = LENGTH) -> DataFrame:
    """Byte ranges [s, e) of keyed texts that a window with another (or, an earlier) occurrence covers; ranges may overlap."""
    rows = checkpointed(text_runs(docs, length))
    first = F.min(F.struct("doc_id", "k1", "lo", "k2", "n")).alias("first")
    classes = rows.groupBy("h", "s1", "s2").agg(F.count("*").alias("n_runs"), first, F.max("again").alias("again"))
    sums = classes.groupBy("h").agg(F.count("*").alias("kinds"), F.sum(F.col("first.n") + length - 1).alias("bytes")).where("kinds > 1")
    classes = checkpointed(classes.join(sums, "h", "left").where("n_runs > 1 or kinds is not null or again"))
    needed = classes.where("kinds is not null or again")
    needed = needed.select("first.doc_id", "first.k1", "first.k2", "first.lo", "first.n", "h", (F.coalesce("bytes", F.lit(0)) > HOT).alias("hot"))
    spans = spans_of(docs, needed.select("k1", "k2", "lo", "n", "h", "hot"), length)
    hot = not needed.where("hot").isEmpty()
    spans = checkpointed(spans) if hot else spans
    cold = spans.where("not hot").repartition("h").sortWithinPartitions("h", "doc_id", "k1", "lo").select("h", "k1", "k2", "lo", "span").mapInArrow(sort_spans(first_stays, length), RANGES)
    whole = repeated_runs(rows.drop("again"), classes, first_stays)
    out = whole.select("k1", "k2", F.col("lo").alias("s"), (F.col("lo") + F.col("n") + length - 1).alias("e")).union(cold)
    if hot:
        windows = checkpointed(spans.where("hot").select("doc_id", "k1", "k2", "lo", "span").mapInArrow(each_window(length), f"w1 long, w2 long, doc_id {id_type(docs, 'doc_id')}, k1 long, k2 long, at long"))
        names, place = ["w1", "w2"], F.struct("doc_id", "k1", "at")
        twice = windows.groupBy(*names).agg(F.count("*").alias("n"), F.min(place).alias("first")).where("n > 1").drop("n")
        windows = windows.join(twice, names)
        windows = windows.where(~place.eqNullSafe(F.col("first"))) if first_stays else windows
        out = out.union(windows.select("k1", "k2", F.col("at").alias("s"), (F.col("at") + length).alias("e")))
    return out.distinct()


def merged(ranges: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for s, e in sorted(ranges):
        if out and s <= out[-1][1]:
            out[-1] = (out[-1][0], max(e, out[-1][1]))
        else:
            out.append((s, e))
    return out


def whole_characters(text: bytes, ranges: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The ranges without the parts of characters at their ends."""
    out = []
    for s, e in ranges:
        while s < e and text[s] & 0xC0 == 0x80:
            s += 1
        while e > s and e < len(text) and text[e] & 0xC0 == 0x80:
            e -= 1
        if s < e:
            out.append((s, e))
    return out


def without_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", first_stays: bool = True, characters: bool = True, carry: tuple[str, ...] = (), length: int = LENGTH) -> DataFrame:
    """``n_bytes``, ``n_removed``, ``n_spans``, the removed byte ranges as ``spans``, ``kept`` (the rest) and ``kept_sha256`` of each row.

    A byte goes if a string of ``length`` bytes that covers it occurs at an earlier place, the order being that of the identifiers, then
    of places (or, without ``first_stays``, at any other place, in the same text included). ``characters`` leaves cut
    characters whole. Null texts are empty; shorter texts lose nothing; rows that repeat identifier and text, or have
    a null identifier, are places of their own, so that the first of them keeps its text.
    ``carry`` names columns that come along as row_0, row_1 and so on.
    """
    texts = keyed_texts(docs, id_col, text_col, first_stays, carry)
    lists = repeated_ranges(texts, first_stays, length).groupBy("k1", "k2").agg(F.collect_list(F.struct("s", "e")).alias("ranges"))
    more = tuple(f"row_{i}" for i in range(len(carry)))

    def make():
        import zstandard

        unpack = zstandard.ZstdDecompressor()

        def each(batch):
            out: dict[str, list] = {k: [] for k in ("n_bytes", "n_removed", "n_spans", "spans", "kept", "kept_sha256")}
            for packed, found in zip(batch["packed"].to_pylist(), batch["ranges"].to_pylist(), strict=True):
                text = unpack.decompress(packed)
                spans = merged([(r["s"], r["e"]) for r in found or []])
                spans = whole_characters(text, spans) if characters else spans
                edges = [0, *(x for span in spans for x in span), len(text)]
                kept = b"".join(text[a:b] for a, b in zip(edges[::2], edges[1::2], strict=True))
                for k, v in (("n_bytes", len(text)), ("n_removed", len(text) - len(kept)), ("n_spans", len(spans)), ("spans", [{"s": s, "e": e} for s, e in spans]), ("kept", kept), ("kept_sha256", hashlib.sha256(kept).hexdigest())):
                    out[k].append(v)
            return out | {k: batch[k] for k in ("doc_id", *more)}

        return each

    joined = compressed(texts, more).join(lists, ["k1", "k2"], "left").select("doc_id", "packed", "ranges", *more)
    kinds = "".join(f", {m} {docs.schema[c].dataType.simpleString()}" for m, c in zip(more, carry, strict=True))
    return map_rows(joined, make, f"doc_id {id_type(docs, id_col)}, n_bytes long, n_removed long, n_spans long, spans array<struct<s: long, e: long>>, kept binary, kept_sha256 string{kinds}")
