"""LM scoring by logistic context mixing: hashed-context bit predictors, gated weights and an adaptive refinement.

Counts of the whole training corpus are gathered as packed rows: of words, dealt by hash, of byte sequences and of words'
beginnings, which give every predictor its counts. Texts are kept in blocks, so that word counts come back to a block as
few rows. Weights and refinement are learned online from all training texts, block by block.
"""

from __future__ import annotations

from dataclasses import dataclass
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from facetry.llm.texts import bucket_of, checkpointed, id_type, map_rows

#: Context lengths in bytes, 0 for the word as far as it goes, and the logarithm of the slots of each predictor's table.
ORDERS, SLOT_BITS = (1, 2, 3, 4, 0), (16, 20, 22, 22, 24)
#: Bytes of text in a block, and in what is looked at together; sequences that a task holds before it hands them on.
BLOCK, SLICE, HELD = 4 << 20, 2 << 20, 3 << 20
#: Cells that counts are dealt to, and groups that are summed at once; more are summed in levels.
FAN = 256
#: Slots of a table that are summed and sent at once.
CHUNK = 1 << 15
#: The byte that ends a text and stands before it; UTF-8 has no such byte. The key of the end among words.
END, END_WORD = 0xFF, b" "
#: Weight sets: by the longest context seen before and how often; refinement cells by that context and the mixed odds.
SEEN, CELLS, REFINED = 4, 33, 0.5
#: Steps of the mixed odds for which refined probabilities are tabled.
STEPS = 1 << 12
#: Sites that are mixed together, few enough for their arrays to stay in a processor's cache.
FEW = 4096
PRIOR, CLIP = 0.3, 8.0
#: A slot's zeros and ones are a byte each: the number of the level at or below the count, in steps of a twentieth from 32 on.
LEVELS = np.concatenate([np.arange(32), np.floor(32 * 1.05 ** np.arange(224))])
_MIX, _STEP = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)
_APART = np.isin(np.arange(256), (32, END))
_LETTER = np.random.default_rng(2).integers(1 << 63, size=256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def blocks(docs: DataFrame, learn: Column, id_col: str = "doc_id", text_col: str = "text", block: int = BLOCK) -> DataFrame:
    """Rows of about ``block`` bytes of text: ``block``, the identifiers, whether each is learned from, and the texts, compressed. A longer text is a block of its own."""

    def make():
        import zstandard

        pack, held, state = zstandard.ZstdCompressor(level=1), [], {"size": 0, "n": 0}

        def close():
            texts = [x[2] for x in held]
            row = {"block": [TaskContext.get().partitionId() << 32 | state["n"]], "ids": [[x[0] for x in held]], "learn": [[x[1] for x in held]], "ends": [np.cumsum([len(t) for t in texts]).tolist()], "packed": [pack.compress(b"".join(texts))]}
            held.clear()
            state["size"], state["n"] = 0, state["n"] + 1
            return row

        def each(batch):
            out: dict[str, list] = {k: [] for k in ("block", "ids", "learn", "ends", "packed")}
            for x in zip(batch["doc_id"].to_pylist(), batch["learn"].to_pylist(), (t or b"" for t in batch["text"].to_pylist()), strict=True):
                held.append(x)
                state["size"] += len(x[2])
                if state["size"] >= block:
                    for k, v in close().items():
                        out[k] += v
            return out if out["block"] else None

        each.finish = lambda: close() if held else None
        return each

    kind = id_type(docs, id_col)
    rows = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.coalesce(learn, F.lit(False)).alias("learn"), F.col(f"`{text_col}`").cast("string").cast("binary").alias("text"))
    return map_rows(rows, make, f"block long, ids array<{kind}>, learn array<boolean>, ends array<long>, packed binary")


def words_of(row: dict) -> list[list[bytes]]:
    """The lower-cased words of each text of a block."""
    import zstandard

    joined = zstandard.ZstdDecompressor().decompress(row["packed"]).lower()
    return [joined[a:b].split() for a, b in zip([0, *row["ends"]], row["ends"])]


def block_words(row: dict) -> tuple[list[np.ndarray], np.ndarray, list[list[bytes]]]:
    """For each text the numbers of its words and the end, and the hashes of the numbered words in order."""
    from xxhash import xxh64_intdigest

    texts = words_of(row)
    size = np.array([len(words) + 1 for words in texts], np.int64)
    hashes = np.fromiter(map(xxh64_intdigest, chain.from_iterable([*words, END_WORD] for words in texts)), np.uint64, int(size.sum()))
    ids, found = pd.factorize(hashes)
    return np.split(ids, np.cumsum(size)[:-1]), found, texts


def slices(texts: list[list[bytes]]):
    """Runs of texts of about SLICE bytes, so that what is looked at together takes bounded memory; a longer text is a run of its own."""
    held, size = [], 0
    for words in texts:
        n = sum(map(len, words)) + len(words)
        if held and size + n > SLICE:
            yield held
            held, size = [], 0
        held.append(words)
        size += n
    if held:
        yield held


def sites_of(texts: list[list[bytes]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each byte of the texts (words with single spaces) and their ends: the five bytes up to and with it, as one number;
    a hash of its word so far with the byte below; and each text's share of them."""
    width = max(ORDERS)
    lead, tail = bytes([END]) * width, bytes([END])
    joined = [b" ".join(words) for words in texts]
    raw = b"".join([*(x for t in joined for x in (lead, t, tail)), bytes(7 - width)])
    buffer = np.frombuffer(raw, np.uint8, len(raw) - 7 + width)
    size = np.array([len(t) + 1 for t in joined], np.int64)
    starts = np.cumsum(size + width) - size - width  # of what stands before each text
    own = np.ones(len(buffer), bool)
    own[starts[:, None] + np.arange(width)] = False
    own, here = own[width:], buffer[width:]
    key = np.ndarray(len(here), ">u8", raw, 0, (1,)).astype(np.uint64)  # the eight bytes from each place on
    key >>= np.uint64(56 - 8 * width)
    bounds = np.flatnonzero(np.take(_APART, buffer))
    length = np.diff(np.append(bounds, len(buffer)))
    power = np.cumprod(np.full(int(length.max(initial=0)) + 1, _STEP))
    value = np.take(_LETTER, buffer)
    value *= np.take(power, np.arange(len(buffer)) - np.repeat(bounds, length))  # by what came before the word; a text starts with a bound
    total = np.cumsum(value, dtype=np.uint64, out=value)
    total -= np.repeat(total[bounds], length)
    word = total[width - 1 : -1]
    word *= _MIX
    word >>= np.uint64(32)
    word <<= np.uint64(8)
    word |= here
    return key[own], word[own], size


def distinct_sites(keys: np.ndarray, words: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The different pairs, where each came from, and how often each occurs."""
    back, found = pd.factorize((keys * _STEP ^ words) * _MIX)
    first = np.flatnonzero(np.diff(np.maximum.accumulate(back), prepend=-1))  # numbers rise where they are new
    return keys[first], words[first], back, np.bincount(back, minlength=len(found))


def block_sites(texts: list[list[bytes]]) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[tuple[np.ndarray, np.ndarray]]]:
    """The different sites of a block's texts, how often each occurs, and for each slice of the texts its sites' numbers and each text's share of them."""
    found = [(*distinct_sites(*some[:2]), some[2]) for some in map(sites_of, slices(texts))]
    if not found:
        return np.zeros(0, np.uint64), np.zeros(0, np.uint64), np.zeros(0, np.int64), []
    keys, words, back, _ = distinct_sites(np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found]))
    own = np.split(back, np.cumsum([len(f[0]) for f in found])[:-1])
    n = np.bincount(back, weights=np.concatenate([f[3] for f in found]), minlength=len(keys))
    return keys, words, n.astype(np.int64), [(numbers[f[2]], f[4]) for numbers, f in zip(own, found, strict=True)]


def cell_of(keys: np.ndarray, fan: int, level: int = 0) -> np.ndarray:
    """The cell, of ``fan`` (a power of two, 256 at most), that a key is dealt to at a level."""
    return ((keys * _MIX) >> np.uint64(56 - 8 * level)).astype(np.int64) & (fan - 1)


def dealt(keys: np.ndarray, counts: np.ndarray, fan: int, level: int = 0):
    """The keys and counts of each cell that has any, in the order of the keys given."""
    cell = cell_of(keys, fan, level)
    order = np.argsort(cell.astype(np.uint8), kind="stable")
    bounds = np.searchsorted(cell[order], np.arange(fan + 1))
    for c in range(fan):
        rows = order[bounds[c] : bounds[c + 1]]
        if len(rows):
            yield c, keys[rows], counts[rows]


def shortened(keys: np.ndarray, kind: int) -> bytes:
    """Words' hashes have eight bytes; sequences and words so far with the next byte have five that aren't zero."""
    return keys.tobytes() if kind == 0 else np.ascontiguousarray(keys.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :5]).tobytes()


def lengthened(packed: bytes, kind: int) -> np.ndarray:
    if kind == 0:
        return np.frombuffer(packed, np.uint64)
    out = np.zeros((len(packed) // 5, 8), np.uint8)
    out[:, :5] = np.frombuffer(packed, np.uint8).reshape(-1, 5)
    return out.view(np.uint64).ravel()


def narrow(counts: np.ndarray) -> bytes:
    """The counts in the fewest bytes that hold them all."""
    return counts.astype(next(t for t in ("<u1", "<u2", "<u4", "<i8") if counts.max(initial=0) <= np.iinfo(t).max)).tobytes()


def widened(packed: bytes, n: int) -> np.ndarray:
    size = len(packed) // max(n, 1)
    return np.frombuffer(packed, f"<u{size}" if size < 8 else "<i8").astype(np.int64)


COUNTED = "kind int, cell long, of long, keys binary, counts binary"


def table_of(rows: dict) -> pa.Table:
    kinds = {"kind": pa.int32(), "cell": pa.int64(), "of": pa.int64(), "keys": pa.binary(), "counts": pa.binary()}
    return pa.table({k: pa.array(rows[k], kind) for k, kind in kinds.items()})


def counted(blocked: DataFrame, fan: int) -> DataFrame:
    """Packed counts, in texts learned from: of each block's words (kind 0; ``of``: the block), and of the task's five-byte sequences (kind 1) and words so far with the next byte (kind 3). Each block and hand-on has at most ``fan`` rows a kind."""

    def make():
        sites: dict[int, list[tuple[np.ndarray, np.ndarray]]] = {1: [], 3: []}
        state = {"n": 0}

        def fold(held):
            keys, back = np.unique(np.concatenate([g[0] for g in held]), return_inverse=True)
            held[:] = [(keys, np.bincount(back, weights=np.concatenate([g[1] for g in held])).astype(np.int64))]

        def add(out, kind, of, keys, counts):
            for cell, k, c in dealt(keys, counts, fan):
                for name, v in (("kind", kind), ("cell", cell), ("of", of), ("keys", shortened(k, kind)), ("counts", narrow(c))):
                    out[name].append(v)

        def hand_on(out, most):
            for kind, held in sites.items():
                if sum(len(k) for k, _ in held) > most:
                    fold(held)
                    if len(held[0][0]) > most // 2:
                        state["n"] += 1
                        add(out, kind, TaskContext.get().partitionId() << 32 | state["n"], *held.pop())

        def each(batch):
            out: dict[str, list] = {k: [] for k in ("kind", "cell", "of", "keys", "counts")}
            for row in batch.to_pylist():
                ids, hashes, texts = block_words(row)
                learned = [x for x, ok in zip(ids, row["learn"], strict=True) if ok]
                counts = np.bincount(np.concatenate(learned), minlength=len(hashes)) if learned else np.zeros(len(hashes), np.int64)
                add(out, 0, row["block"], hashes, counts)
                for few in slices([t for t, ok in zip(texts, row["learn"], strict=True) if ok]):
                    for kind, keys in zip(sites, sites_of(few)):
                        sites[kind].append(np.unique(keys, return_counts=True))
                    hand_on(out, HELD)
            return out

        def finish():
            out: dict[str, list] = {k: [] for k in ("kind", "cell", "of", "keys", "counts")}
            hand_on(out, 0)
            return out if out["kind"] else None

        each.finish = finish
        return each

    return map_rows(blocked.select("block", "learn", "ends", "packed"), make, COUNTED)


def added(table) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """A cell's different keys, their counts over all rows, and the numbers of each row's keys among them."""
    kind = table["kind"][0].as_py()
    keys = [lengthened(x, kind) for x in table["keys"].to_pylist()]
    found, back = np.unique(np.concatenate(keys), return_inverse=True)
    total = np.bincount(back, weights=np.concatenate([widened(x, len(k)) for x, k in zip(table["counts"].to_pylist(), keys, strict=True)]))
    return found, total.astype(np.int64), np.split(back, np.cumsum([len(k) for k in keys])[:-1])


def replies(kind: int, cell: int, total: np.ndarray, names: list, numbers: list[np.ndarray]) -> dict:
    import zstandard

    pack = zstandard.ZstdCompressor(level=1)
    n = len(names)
    return {"kind": [kind] * n, "cell": [cell] * n, "of": names, "keys": [None] * n, "counts": [pack.compress(total[x].astype("<i8").tobytes()) for x in numbers]}


def summed(rows: DataFrame, n_groups: int, fan: int, level: int = 0) -> DataFrame:
    """Of the counts of up to ``n_groups`` groups: for each group and cell of words the counts over all groups, packed, in the order of its keys (kind 0);
    their sum and number (kind 2); and the summed sequences (kinds 1 and 3).

    Up to fan groups meet at once. More are first summed in sets of about fan, whose cells are dealt out anew, fan to a cell,
    so that rows grow with the groups and what meets in a task doesn't.
    """

    def last(key, table):
        kind, cell = key[0].as_py(), key[1].as_py()
        found, total, numbers = added(table)
        if kind:
            return table_of({"kind": [kind], "cell": [cell], "of": [None], "keys": [shortened(found, kind)], "counts": [narrow(total)]})
        out = replies(0, cell, total, table["of"].to_pylist(), numbers)
        sums = np.array([total.sum(), (total > 0).sum()], ">i8").tobytes()
        return table_of({k: [*out[k], x] for k, x in (("kind", 2), ("cell", cell), ("of", None), ("keys", None), ("counts", sums))})

    if n_groups <= fan:
        return rows.groupBy("kind", "cell").applyInArrow(last, COUNTED)
    n_sets = -(-n_groups // fan)
    rows = checkpointed(rows.withColumn("set", F.pmod(F.xxhash64("of", F.lit(level)), F.lit(n_sets)).cast("long")))

    def merge(key, table):
        kind, cell, set_ = (k.as_py() for k in key)
        found, total, _ = added(table)
        out: dict[str, list] = {k: [] for k in ("kind", "cell", "of", "keys", "counts")}
        for digit, k, c in dealt(found, total, fan, level + 1):
            for name, v in (("kind", kind), ("cell", cell * fan + digit), ("of", set_), ("keys", shortened(k, kind)), ("counts", narrow(c))):
                out[name].append(v)
        return table_of(out)

    def back(key, own, above):
        cell = key[0].as_py()
        if not own.num_rows:
            return table_of({k: [] for k in ("kind", "cell", "of", "keys", "counts")})
        found, total, numbers = added(own)
        digit = cell_of(found, fan, level + 1)
        for c, x in zip(above["cell"].to_pylist(), above["counts"].to_pylist(), strict=True):
            total[digit == c % fan] = opened(x)
        return table_of(replies(0, cell, total, own["of"].to_pylist(), numbers))

    sets = checkpointed(summed(rows.groupBy("kind", "cell", "set").applyInArrow(merge, COUNTED), n_sets, fan, level + 1))
    above = sets.where("kind = 0").withColumns({"under": F.floor(F.col("cell") / fan), "set": F.col("of")})
    down = rows.where("kind = 0").groupBy("cell", "set").cogroup(above.groupBy("under", "set")).applyInArrow(back, COUNTED)
    return sets.where("kind != 0").union(down)


def opened(packed: bytes) -> np.ndarray:
    import zstandard

    return np.frombuffer(zstandard.ZstdDecompressor().decompress(packed), "<i8")


def counts_of(hashes: np.ndarray, found: list[dict], fan: int) -> np.ndarray:
    """The counts of a block's words from their cells' replies."""
    counts, cell = np.zeros(len(hashes), np.int64), cell_of(hashes, fan).astype(np.uint8)
    order, ends = np.argsort(cell, kind="stable"), np.cumsum(np.bincount(cell, minlength=fan))
    for r in found:
        own = opened(r["counts"])
        counts[order[ends[r["cell"]] - len(own) : ends[r["cell"]]]] = own
    return counts


#: For each byte, the numbers of its bits' places after those before, of the first four and of the last four.
_PATH = np.array([[1 << j | half >> (4 - j) for half in (byte >> 4, byte & 15) for j in range(4)] for byte in range(256)])


def paths_of(sites: np.ndarray) -> np.ndarray:
    """For each site the places of the eight bits of its last byte within a context's slots, which lie together for four bits each."""
    return np.take(_PATH, (sites & np.uint64(255)).view(np.int64), axis=0)


def nodes_of(sites: np.ndarray, order: int, paths: np.ndarray | None = None) -> np.ndarray:
    """For each site the slots of the eight bits of its last byte, after the ``ORDERS[order]`` bytes before or the word so far."""
    length, paths = ORDERS[order], paths_of(sites) if paths is None else paths
    context = sites & np.uint64((1 << 8 * (length or 7)) - 1 << 8)
    base = np.empty((len(sites), 2), np.uint64)
    base[:, 0], base[:, 1] = context, context | np.uint64(16) | (sites >> np.uint64(4) & np.uint64(15))
    base *= _MIX
    base ^= base >> np.uint64(29)
    base *= _MIX
    base >>= np.uint64(64 - SLOT_BITS[order])
    out = paths.reshape(-1, 2, 4) + base.view(np.int64)[:, :, None]
    out &= (1 << SLOT_BITS[order]) - 1
    return out.reshape(-1, 8)


def bits_of(keys: np.ndarray) -> np.ndarray:
    return np.unpackbits(keys.astype(np.uint8)[:, None], axis=1)


def levels_of(pair: np.ndarray) -> np.ndarray:
    """Zeros and ones of each slot as one number of 16 bits, scaled down together where a count is above the highest level."""
    scale = np.maximum(1.0, pair.max(axis=1, keepdims=True) / LEVELS[-1])
    level = np.searchsorted(LEVELS, np.where(pair > 0, np.maximum(1, np.floor(pair / scale)), 0), "right") - 1
    return (level[:, 0] | level[:, 1] << 8).astype("<u2")


def readings() -> np.ndarray:
    """The odds of a one for each slot's number: as it is, with a zero left out, with a one left out. The last three bits of a number tell how often it was seen (0: never, else 1 to SEEN)."""
    zeros, ones = (np.tile(x, (3, 1)) for x in (np.tile(LEVELS, 256), np.repeat(LEVELS, 256)))
    zeros[1], ones[2] = np.maximum(zeros[1] - 1, 0), np.maximum(ones[2] - 1, 0)
    odds, times = np.clip(np.log((ones + PRIOR) / (zeros + PRIOR)), -CLIP, CLIP).astype(np.float32), zeros + ones
    seen = np.where(times > 0, 1 + np.digitize(times, (2, 6, 40)), 0)
    return ((odds.view(np.int32) & ~7) | seen.astype(np.int32)).view(np.float32).ravel()


#: The weight set for each way the predictors' contexts may have been seen, three bits each.
_SETS = np.max([np.where(t > 0, t + (order + 1) * SEEN - 1, 0) for order in range(len(ORDERS)) for t in (np.arange(8 ** len(ORDERS)) >> 3 * order & 7,)], axis=0)


def predictor_tables(sites: DataFrame, n_rows: int, fan: int) -> list[np.ndarray]:
    """For each order the zeros and ones seen in each slot, as levels: fixed sizes, whatever the corpus."""

    def make():
        def each(batch):
            out: dict[str, list] = {k: [] for k in ("order", "chunk", "slots", "counts")}
            for kind, k, c in zip(batch["kind"].to_pylist(), batch["keys"].to_pylist(), batch["counts"].to_pylist(), strict=True):
                keys = lengthened(k, kind)
                counts = widened(c, len(keys))
                bit = bits_of(keys).ravel()
                for order in [i for i, length in enumerate(ORDERS) if (length > 0) == (kind == 1)]:
                    slot = nodes_of(keys, order).ravel() * 2 + bit
                    by_slot = np.argsort(slot)
                    slot = slot[by_slot]
                    first = np.flatnonzero(np.append(True, slot[1:] != slot[:-1]))
                    slot, total = slot[first], np.add.reduceat(np.repeat(counts, 8)[by_slot], first)
                    cut = np.flatnonzero(np.diff(slot // (2 * CHUNK))) + 1
                    for s, n in zip(np.split(slot, cut), np.split(total, cut), strict=True):
                        if len(s):
                            for name, v in (("order", order), ("chunk", s[0] // (2 * CHUNK)), ("slots", (s % (2 * CHUNK)).astype("<u2").tobytes()), ("counts", narrow(n))):
                                out[name].append(v)
            return out

        return each

    def total_of(table):
        total = np.zeros(2 * CHUNK, np.int64)
        for s, n in zip(table["slots"].to_pylist(), table["counts"].to_pylist(), strict=True):
            slots = np.frombuffer(s, "<u2")
            total[slots] += widened(n, len(slots))
        return total

    def row(key, slots, counts):
        return pa.table({"order": pa.array([key[0].as_py()], pa.int32()), "chunk": pa.array([key[1].as_py()], pa.int32()), "slots": pa.array([slots], pa.binary()), "counts": pa.array([counts], pa.binary())})

    def some(key, table):
        total = total_of(table)
        return row(key, (at := np.flatnonzero(total)).astype("<u2").tobytes(), narrow(total[at]))

    def last(key, table):
        return row(key, None, levels_of(total_of(table).reshape(-1, 2)).tobytes())

    kind = "order int, chunk int, slots binary, counts binary"
    parts = map_rows(sites, make, kind)
    while n_rows > fan:  # a chunk has a row of each row of sequences at most: they are added up in sets of about ``fan``
        n_rows = -(-n_rows // fan)
        parts = parts.groupBy("order", "chunk", F.pmod(F.xxhash64("slots", "counts", F.lit(n_rows)), F.lit(n_rows))).applyInArrow(some, kind)
    tables = [np.zeros(1 << b, np.uint16) for b in SLOT_BITS]
    for r in parts.groupBy("order", "chunk").applyInArrow(last, kind).toLocalIterator():  # the tables' fixed size in all
        small = np.frombuffer(r.counts, "<u2")
        tables[r.order][r.chunk * CHUNK : r.chunk * CHUNK + len(small)] = small[: len(tables[r.order])]
    return tables


def packed(tables: list[np.ndarray]) -> list[bytes]:
    import zstandard

    return [zstandard.ZstdCompressor(level=1).compress(t.tobytes()) for t in tables]


def unpacked(tables: list[bytes]) -> list[np.ndarray]:
    import zstandard

    return [np.frombuffer(zstandard.ZstdDecompressor().decompress(t), np.uint16) for t in tables]


@dataclass
class ContextMixing:
    tables: list[np.ndarray]
    weights: np.ndarray
    refined: np.ndarray

    def __post_init__(self):
        self.odds = readings()

    @classmethod
    def new(cls, tables: list[np.ndarray]) -> ContextMixing:
        weights = np.full(((len(ORDERS) + 1) * SEEN, len(ORDERS) + 1), 0.3, np.float32)
        weights[:, -1] = 0.0
        return cls(tables, weights, np.tile(logistic(np.linspace(-CLIP, CLIP, CELLS)), (len(ORDERS) + 1, 1)))

    def inputs(self, keys: np.ndarray, words: np.ndarray, without: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """The predictors' odds of a one, a row for each, and the weight set, for each of eight bits; ``without``: the bits, each left out once of what was counted."""
        odds, paths = np.empty((len(ORDERS) + 1, len(keys), 8), np.float32), paths_of(keys)
        odds[-1] = 0.3
        times = np.zeros((len(keys), 8), np.int32)  # three bits for each predictor
        more = None if without is None else (without.astype(np.int64) + 1) << 16
        for order, table in enumerate(self.tables):  # all numbers are in range, and clipping saves a copy of what is taken
            slot = np.take(table, nodes_of(keys if ORDERS[order] else words, order, paths), mode="clip").astype(np.int64)
            if more is not None:
                slot += more
            np.take(self.odds, slot, out=odds[order], mode="clip")
            own = odds[order].view(np.int32) & 7
            own <<= 3 * order
            times += own
        return odds, np.take(_SETS, times, mode="clip")

    def mix(self, odds: np.ndarray, gate: np.ndarray) -> np.ndarray:
        out, weighted, set_ = np.zeros(gate.shape, np.float32), np.empty(gate.shape, np.float32), gate.astype(np.int64, copy=False)
        for k in range(len(odds)):
            np.take(np.ascontiguousarray(self.weights[:, k]), set_, out=weighted, mode="clip")
            weighted *= odds[k]
            out += weighted
        return np.clip(out, -CLIP * 1.5, CLIP * 1.5, out=out)

    def refined_logs(self) -> np.ndarray:
        """log10 of the probability of each bit, by the longest context seen, the bit and the step of the mixed odds: the mixed probability, averaged with what followed such odds before."""
        mixed = (np.arange(STEPS) + 0.5) / STEPS * 3 * CLIP - 1.5 * CLIP
        at = np.linspace(-CLIP, CLIP, CELLS)
        p = np.stack([(1 - REFINED) * logistic(mixed) + REFINED * np.interp(mixed, at, row) for row in self.refined])
        p = np.clip(p, 1e-6, 1 - 1e-6)
        return np.log10(np.stack([1 - p, p], axis=1))

    def log10(self, keys: np.ndarray, words: np.ndarray) -> np.ndarray:
        """log10 probability of each site's byte after what is before it."""
        out, logs = np.empty(len(keys)), self.refined_logs().ravel()
        order = np.argsort(keys)  # contexts that are alike lie together in the tables
        for i in range(0, len(keys), 2 * FEW):
            rows = order[i : i + 2 * FEW]
            few = keys[rows]
            odds, gate = self.inputs(few, words[rows])
            mixed = self.mix(odds, gate)
            mixed += np.float32(1.5 * CLIP)
            mixed *= np.float32(STEPS / (3 * CLIP))
            step = mixed.astype(np.int64)
            np.minimum(step, STEPS - 1, out=step)
            gate //= SEEN
            gate <<= 1
            gate += bits_of(few)
            gate *= STEPS
            step += gate
            out[rows] = np.take(logs, step, mode="clip").sum(axis=1)
        return out


def logistic(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-x))


def learn_online(blocked: DataFrame, tables) -> ContextMixing:
    """Weights and refinement from all texts learned from: each task learns online from its own blocks, tasks are averaged by what they saw.

    A byte's own occurrence is left out of the counts that predict it, as a new text's would be. ``tables`` is the
    broadcast of the predictors' packed tables; the model returned has none, as tasks hold them already.
    """
    model = ContextMixing.new([])
    n_sets, n_inputs = model.weights.shape

    def make():
        own, square = ContextMixing.new(unpacked(tables.value)), np.full((n_sets, n_inputs), 1e-3)
        seen, cells = [0], np.zeros((2, len(ORDERS) + 1, CELLS))

        def step(keys, words, n):
            bit = bits_of(keys)
            odds, gate = own.inputs(keys, words, bit)
            mixed = own.mix(odds, gate)
            cell = np.clip(np.rint((mixed + CLIP) * ((CELLS - 1) / (2 * CLIP))), 0, CELLS - 1).astype(np.int64)
            set_, weight = gate.ravel(), np.repeat(n.astype(float), 8)
            at = (bit * np.int64(cells[0].size) + gate // SEEN * CELLS + cell).ravel()
            cells[:] += np.bincount(at, weights=weight, minlength=cells.size).reshape(cells.shape)
            off = (bit - logistic(mixed)) * n[:, None].astype(np.float32)
            grad = np.stack([np.bincount(set_, weights=(off * o).ravel(), minlength=n_sets) for o in odds], axis=1)
            grad /= np.maximum(np.bincount(set_, weights=weight, minlength=n_sets), 1)[:, None]
            square[:] += grad * grad
            own.weights += (0.05 * grad / np.sqrt(square)).astype(np.float32)
            seen[0] += int(n.sum())

        def each(batch):
            for row in batch.to_pylist():
                keys, words, n, _ = block_sites([t for t, ok in zip(words_of(row), row["learn"], strict=True) if ok])
                mixed_up = np.argsort(keys * _STEP ^ words)  # as neighbours in a text are alike
                keys, words, n = keys[mixed_up], words[mixed_up], n[mixed_up]
                for i in range(0, len(keys), FEW):
                    step(keys[i : i + FEW], words[i : i + FEW], n[i : i + FEW])

        each.finish = lambda: {"n": [float(seen[0])], "weights": [own.weights.astype(np.float64).tobytes()], "cells": [cells.tobytes()]} if seen[0] else None
        return each

    n, weights, cells = 0.0, 0.0, 0.0
    for r in checkpointed(map_rows(blocked.select("learn", "ends", "packed"), make, "n double, weights binary, cells binary")).toLocalIterator():  # a small row a task
        n, weights, cells = n + r.n, weights + r.n * np.frombuffer(r.weights), cells + np.frombuffer(r.cells)
    if n:
        model.weights = (weights / n).reshape(model.weights.shape).astype(np.float32)
        zeros, ones = cells.reshape(2, *model.refined.shape)
        model.refined = (ones + 20 * model.refined) / (zeros + ones + 20)
    return model


def score_texts(docs: DataFrame, learn: Column, id_col: str = "doc_id", text_col: str = "text", block: int = BLOCK, fan: int = FAN) -> DataFrame:
    """``n_tokens``, ``n_known``, ``train_tokens``, ``base_score``, ``score`` and ``bits_per_byte`` of each row.

    A text is its lower-cased words and an end, single spaces between: both scores are log10 probabilities of that. A null or
    empty text is an end alone. Texts for which ``learn`` is null aren't learned from; with none learned from, words have
    count 0 and bits even odds. Repeated rows count as often as they occur. Counts don't depend on the order of texts; weights
    are learned online, so in the last digits a score depends on how texts lie in partitions.
    """
    blocked = checkpointed(blocks(docs, learn, id_col, text_col, block))
    found = checkpointed(summed(counted(blocked, fan), blocked.count(), fan))
    sums = found.where("kind = 2").select(*(F.conv(F.hex(F.substring("counts", at, 8)), 16, 10).cast("long").alias(k) for k, at in (("n", 1), ("v", 9)))).agg(F.sum("n"), F.sum("v")).first()
    n_train, distinct = sums[0] or 0, sums[1] or 0
    sites = found.where("kind in (1, 3)").select("kind", "keys", "counts")
    tables = docs.sparkSession.sparkContext.broadcast(packed(predictor_tables(sites, sites.count(), fan)))  # of a fixed size
    learned = learn_online(blocked, tables)
    lists = found.where("kind = 0").groupBy("of").agg(F.collect_list(F.struct("cell", "counts")).alias("found"))
    kind = docs.schema[id_col].dataType

    def make():
        model = ContextMixing(unpacked(tables.value), learned.weights, learned.refined)

        def each(batch):
            out: dict[str, list] = {k: [] for k in ("doc_id", "n_tokens", "n_known", "train_tokens", "base_score", "score", "bits_per_byte")}
            for row in batch.to_pylist():
                ids, hashes, texts = block_words(row)
                counts = counts_of(hashes, row["found"], fan)
                word = np.log10((counts + 0.5) / (n_train + 0.5 * (distinct + 1)))
                keys, words, _, slices_ = block_sites(texts)
                logs = model.log10(keys, words)
                for numbers, size in slices_:
                    total = np.add.reduceat(logs[numbers], np.cumsum(size) - size)
                    out["score"] += total.tolist()
                    out["bits_per_byte"] += (-total * np.log2(10) / size).tolist()
                out["doc_id"] += row["ids"]
                out["n_tokens"] += [len(x) for x in ids]
                out["n_known"] += [int((counts[x] > 0).sum()) for x in ids]
                out["base_score"] += [float(word[x].sum()) for x in ids]
                out["train_tokens"] += [n_train] * len(ids)
            return out

        return each

    schema = T.StructType([T.StructField("doc_id", kind), *T._parse_datatype_string("n_tokens long, n_known long, train_tokens long, base_score double, score double, bits_per_byte double").fields])
    joined = blocked.join(lists, F.col("block") == F.col("of")).select("ids", "ends", "packed", "found")
    return map_rows(joined, make, schema)


def held_out(id_col: str = "doc_id") -> Column:
    return F.coalesce(bucket_of(F.col(f"`{id_col}`"), 5) == 1, F.lit(False))


def learnable(id_col: str = "doc_id") -> Column:
    return F.coalesce(bucket_of(F.col(f"`{id_col}`"), 5) != 1, F.lit(False))
