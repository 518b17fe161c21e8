"""SimHash near-dedup: fingerprints of word shingles, linked through nearby Golay codewords of their segments."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from facetry.llm.components import connected_components, local_labels
from facetry.llm.golay import nearby
from facetry.llm.texts import checkpointed, id_type, keyed, map_rows

#: Bits of the three segments of a fingerprint.
SEGMENTS = (22, 21, 21)
DISTANCE = 4
#: Keys that one task sorts at once, about.
TASK_KEYS = 1_500_000
#: Runs of equal keys up to this length are compared together; longer ones by blocks.
SHORT, BLOCK = 32, 1024
_MIX = np.uint64(0x9E3779B97F4A7C15)


def fingerprint(text: bytes, width: int = 4, seed: int = 42) -> int:
    """The majority bits of the XXH64 of all word shingles of the text with A-Z lower-cased; 0 without a word."""
    from xxhash import xxh64_intdigest

    words = text.lower().split()  # of bytes: only A-Z, and at space and \x09-\x0D
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) <= width:
        return xxh64_intdigest(joined, seed)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.append(0, ends[:-1] + 1)[: len(words) - width + 1].tolist()
    ones, n = np.zeros(64, np.int64), len(starts)
    ends = ends[width - 1 :].tolist()
    for i in range(0, n, 50_000):
        h = np.array([xxh64_intdigest(joined[a:b], seed) for a, b in zip(starts[i : i + 50_000], ends[i : i + 50_000], strict=True)], np.uint64)
        ones += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > n, bitorder="little").tobytes(), "little")


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 4) -> DataFrame:
    """``doc_id`` and ``bits``, the fingerprint as a signed long; null and empty texts have 0."""

    def make():
        return lambda batch: {"doc_id": batch["doc_id"], "bits": np.array([fingerprint(x or b"", width) for x in batch["text"].to_pylist()], np.uint64).view(np.int64)}

    return map_rows(keyed(docs, id_col, text_col), make, f"doc_id {id_type(docs, id_col)}, bits long")


def keys_of(bits: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Keys of fingerprints: the key, the position of its fingerprint, and whether the key is the fingerprint's own.

    At most 4 differing bits over three segments leave two segments with at most 1 each, or one with none and two with 2.
    For each pair of segments, keys join the indices of nearby codewords of both; those of the two nearest codewords are the
    fingerprint's own, and one of two linked fingerprints has the other's own key. For each segment, keys join its bits with
    the nearby codewords of the next segment; all of these are own.
    """
    at, segments = 0, []
    for n in SEGMENTS:
        segments.append(((bits >> np.uint64(at)) & np.uint64((1 << n) - 1)).astype(np.int64))
        at += n
    near = [nearby(s) for s in segments]
    rows = np.arange(len(bits))
    keys, where, own = [], [], []
    for f, (i, j) in enumerate(((0, 1), (0, 2), (1, 2))):
        for a in range(6):
            for b in range(6):
                ok = (near[i][1] > a) & (near[j][1] > b)
                keys.append(near[i][0][ok, a] << 12 | near[j][0][ok, b] | f << 40)
                where.append(rows[ok])
                own.append(np.full(int(ok.sum()), a == 0 and b == 0))
    for i in range(3):
        j = (i + 1) % 3
        for b in range(6):
            ok = near[j][1] > b
            keys.append(segments[i][ok] << 12 | near[j][0][ok, b] | (3 + i) << 40)
            where.append(rows[ok])
            own.append(np.ones(int(ok.sum()), bool))
    return np.concatenate(keys), np.concatenate(where), np.concatenate(own)


def close(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.bitwise_count(a ^ b) <= DISTANCE


def linked(keys: np.ndarray, bits: np.ndarray, own: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links among fingerprints that share a key, as (fingerprint, smallest fingerprint of its group here): a row for each at most."""
    order = np.lexsort((~own, keys))
    keys, bits, own = keys[order], bits[order], own[order]
    nodes, node = np.unique(bits, return_inverse=True)
    first = np.flatnonzero(np.append(True, keys[1:] != keys[:-1]))
    length = np.diff(np.append(first, len(keys)))
    some, other = [], []
    for n in range(2, SHORT + 1):
        starts = first[length == n]
        left, right = np.triu_indices(n, 1)
        for k in range(0, len(starts), 1 + 2_000_000 // len(left)):
            rows = starts[k : k + 1 + 2_000_000 // len(left), None]
            a, b = (rows + left).ravel(), (rows + right).ravel()
            a, b = (x[own[a]] for x in (a, b))  # own keys come first in a run
            hit = close(bits[a], bits[b])
            some.append(node[a[hit]])
            other.append(node[b[hit]])
    join = lambda x: np.concatenate(x) if x else np.zeros(0, np.int64)
    label = local_labels(len(nodes), join(some), join(other))
    for start, n in zip(first[length > SHORT], length[length > SHORT], strict=True):
        n_own = int(own[start : start + n].sum())
        a_all, b_all = node[start : start + n_own], node[start : start + n]
        for i in range(0, n_own, BLOCK):
            for k in range(0, n, 64 * BLOCK):
                a, b = a_all[i : i + BLOCK], b_all[k : k + 64 * BLOCK]
                if len(set(np.unique(label[a]).tolist()) | set(np.unique(label[b]).tolist())) == 1:
                    continue  # one group already
                x, y = np.nonzero(close(nodes[a][:, None], nodes[b][None, :]) & (label[a][:, None] != label[b][None, :]))
                if len(x):
                    pairs = np.unique(label[a[x]] * len(nodes) + label[b[y]])
                    label = local_labels(len(nodes), *(np.concatenate(p) for p in ((np.arange(len(nodes)), pairs // len(nodes)), (label, pairs % len(nodes)))))
    away = np.flatnonzero(label != np.arange(len(nodes)))
    return nodes[away], nodes[label[away]]


def fingerprint_links(distinct: DataFrame, n: int) -> DataFrame:
    """Links ``a``, ``b`` that connect all of the n distinct fingerprints ``bits`` at 4 or fewer differing bits, and no others.

    Keys are packed by part, so that a row of the shuffle holds many. A task receives all keys of a part, and reduces what it
    finds to at most one link for each fingerprint, however large a group of near copies is.
    """
    parts = max(8, -(-n * 100 // TASK_KEYS))

    def make():
        def each(batch):
            bits = batch["bits"].to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)
            out: dict[str, list] = {"part": [], "packed": []}
            for i in range(0, len(bits), 8192):
                few = bits[i : i + 8192]
                keys, where, own = keys_of(few)
                part = (keys.astype(np.uint64) * _MIX >> np.uint64(32)).astype(np.int64) % parts
                order = np.argsort(part, kind="stable")
                part = part[order]
                packed = np.empty((len(order), 2), np.int64)
                packed[:, 0], packed[:, 1] = (keys << 1 | own)[order], few[where[order]].view(np.int64)
                for p, rows in zip(part[np.flatnonzero(np.diff(part, prepend=-1))], np.split(packed, np.flatnonzero(np.diff(part))+1), strict=True):
                    out["part"].append(p)
                    out["packed"].append(rows.tobytes())
            return out

        return each

    def within(key, table):
        rows = np.concatenate([np.frombuffer(x, np.int64) for x in table["packed"].to_pylist()]).reshape(-1, 2)
        a, b = linked(rows[:, 0] >> 1, np.ascontiguousarray(rows[:, 1]).view(np.uint64), (rows[:, 0] & 1).astype(bool))
        return pa.table({"a": pa.array(a.view(np.int64)), "b": pa.array(b.view(np.int64))})

    return map_rows(distinct.select("bits"), make, "part int, packed binary").groupBy("part").applyInArrow(within, "a long, b long")


def near_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 4) -> DataFrame:
    """``doc_id``, ``bits`` and ``component_id``, the smallest identifier reachable over fingerprints at 4 or fewer differing bits.

    Null and empty texts have fingerprint 0 and link like any other; rows of equal text always link; null identifiers are
    passed over for the smallest, and a group of them alone has null. Groups of copies meet as one fingerprint.
    """
    prints = checkpointed(fingerprints(docs, id_col, text_col, width))
    distinct = checkpointed(prints.groupBy("bits").agg(F.min("doc_id").alias("least")))
    groups = connected_components(fingerprint_links(distinct, distinct.count())).toDF("bits", "component")
    of = distinct.join(groups, "bits", "left").select("bits", "least", F.coalesce("component", "bits").alias("component"))
    least = of.groupBy("component").agg(F.min("least").alias("component_id"))
    table = of.join(least, "component").select("bits", "component_id")
    return prints.join(table, "bits").select("doc_id", "bits", "component_id")


def hexadecimal(column):
    return F.lower(F.lpad(F.hex(column), 16, "0"))


def first_of_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 4) -> DataFrame:
    """The documents, all their columns, without those that have a group's smaller identifier elsewhere.

    Of rows that repeat an identifier and a text one stays; rows with a null identifier stay.
    """
    groups = near_groups(docs, id_col, text_col, width)
    gone = groups.where(F.col("doc_id") != F.col("component_id")).select("doc_id").distinct()
    kept = docs.alias("d").join(gone.alias("g"), F.col(f"d.`{id_col}`") == F.col("g.doc_id"), "left_anti")
    known = F.col(f"`{id_col}`").isNotNull()
    return kept.where(known).dropDuplicates([id_col, text_col]).unionByName(kept.where(~known))
