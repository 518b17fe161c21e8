"""The places where the labels of entities stand in texts, found by hashes of runs of words."""

from __future__ import annotations

from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from facetry.functions.models import Model, matches_of
from facetry.functions.slices import exploded, in_slices
from facetry.functions.tokens import Once, Tokenizer, typed_tokens
from facetry.operators.durable import durable

#: Labels, and characters of them, up to which they are sent to all tasks; more are joined in parts.
SENT, CHARACTERS = 200_000, 1 << 25
#: Parts into which the places of a label are dealt where labels aren't sent.
PARTS = 16
#: Bits for a label in the sets of hashes that tasks get, and the most bits of a set (as a power of two): fuller sets let more places pass, which the join drops.
BITS, LARGEST = 16, 26
PLACES = "array<struct<first:int,words:int,start:int,end:int,k1:bigint,k2:bigint>>"
_PLACE = pa.struct([(k, pa.int32()) for k in ("first", "words", "start", "end")] + [("k1", pa.int64()), ("k2", pa.int64())])
_KEY = pa.struct([("level", pa.int32()), ("words", pa.int32()), ("begin", pa.int64()), ("k1", pa.int64()), ("k2", pa.int64())])


def analysed(text: Column) -> Column:
    """The words of a text as (token, start, end), in order; words that differ in case only are one."""
    return F.transform(typed_tokens(text), lambda t: F.struct(F.lower(t["text"]).alias("token"), t["start"].alias("start"), t["end"].alias("end")))


def labelled(entities: DataFrame, entity: str, label: str, weights: DataFrame | None = None) -> DataFrame:
    """``label_id``, ``entity``, ``label``, ``weight``, ``tokens`` of each distinct label of an entity that has a word. ``weights`` (entity, weight) rank the entities; others weigh 0."""
    distinct = entities.select(F.col(entity).alias("entity"), F.col(label).alias("label")).dropna().distinct()
    found = distinct.join(weights, "entity", "left") if weights else distinct.withColumn("weight", F.lit(0))
    words = found.select("entity", "label", F.coalesce(F.col("weight").cast("long"), F.lit(0).cast("long")).alias("weight"), F.transform(analysed(F.col("label")), lambda t: t["token"]).alias("tokens"))
    return words.where(F.size("tokens") > 0).select(F.sha2(F.to_json(F.struct(F.col("entity").cast("string"), "label")).cast("binary"), 256).alias("label_id"), "*")


def mixed(a: np.ndarray, b: np.ndarray | int) -> np.ndarray:
    """A hash of two hashes, in this order."""
    x = (a ^ (a >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) + np.asarray(b, np.uint64)
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(29))


def word_hashes(texts: pa.Array) -> list[np.ndarray]:
    """Two 64-bit hashes of each word, which is the same in any case."""
    coded = texts.dictionary_encode()
    digests = b"".join(blake2b(w.lower().encode(), digest_size=16).digest() for w in coded.dictionary.to_pylist())
    known, codes = np.frombuffer(digests, "<u8").reshape(-1, 2), coded.indices.to_numpy(zero_copy_only=False)
    return [known[codes, k] if len(codes) else np.zeros(0, np.uint64) for k in (0, 1)]


def doubled(runs: np.ndarray, level: int) -> np.ndarray:
    """From the hashes of runs of 2^level words those of twice as many, from each place; places too near the end have none of any sense."""
    step = 1 << level
    return np.concatenate([mixed(runs[:-step], runs[step:]), runs[-step:]]) if len(runs) > step else runs


def run_hash(runs: np.ndarray, at: np.ndarray, words: int, level: int) -> np.ndarray:
    """The hash of the ``words`` words from each place, by the first and the last 2^level of them."""
    return mixed(mixed(runs[at], runs[at + words - (1 << level)]), words)


def keyed(labels: DataFrame) -> DataFrame:
    """Adds to labels the hash of their words (``k1``, ``k2``), their count, the power of two in it (``level``) and the hash of so many first words (``begin``)."""

    def run(texts: pa.Array) -> pa.Array:
        found = Tokenizer().of_texts(texts)
        sizes = found.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
        runs, starts, out = word_hashes(found.flatten().field("text")), np.cumsum(sizes) - sizes, [None] * len(texts)
        for level in range(int(sizes.max(initial=0)).bit_length()):
            for k in np.flatnonzero((sizes >> level) == 1).tolist():
                at = starts[k : k + 1]
                k1, k2 = (run_hash(r, at, int(sizes[k]), level).view(np.int64)[0].item() for r in runs)
                out[k] = {"level": level, "words": int(sizes[k]), "begin": mixed(runs[0][at], level).view(np.int64)[0].item(), "k1": k1, "k2": k2}
            runs = [doubled(r, level) for r in runs]
        return pa.array(out, _KEY)

    key = F.arrow_udf(lambda texts: in_slices(texts, run), "struct<level:int,words:int,begin:bigint,k1:bigint,k2:bigint>")
    return durable(labels.withColumn("_key", key("label"))).select("*", "_key.*").drop("_key")


def bits_of(labels: DataFrame, column: str, size: int) -> np.ndarray:
    """The set of a column's hashes, as bits."""
    slot = F.col(column).bitwiseAND(F.lit((1 << size) - 1))
    found = labels.select(F.shiftrightunsigned(slot, 6).alias("at"), F.expr(f"shiftleft(1L, int({column} & 63))").alias("bit")).groupBy("at").agg(F.bit_or("bit").alias("bits")).toArrow()
    out = np.zeros(1 << max(size - 6, 0), np.uint64)
    out[found["at"].to_numpy()] = found["bits"].to_numpy().view(np.uint64)
    return out


def label_places(texts: DataFrame, id_col: str, text_col: str, labels: DataFrame, holding: Model | None = None) -> DataFrame:
    """``doc_id``, ``first``, ``words``, ``start``, ``end``, ``k1``, ``k2``: the places where the words of labels (``keyed``) may stand, and those of all that do; those that hold a match of a model, if one is given.

    A task has a text's words, and of the labels sets of their hashes, of at most 2^LARGEST bits. A place passes if the hash of
    its first words begins a label, and that of all words is one's. What passes by chance is dropped by the join with the labels.
    """
    told = labels.groupBy("level", "words").count().collect()  # a row for each length that a label has
    lengths: dict[int, list[int]] = {}
    for r in told:
        lengths.setdefault(r["level"], []).append(r["words"])
    size = min(LARGEST, max(10, (BITS * sum(r["count"] for r in told)).bit_length()))
    sets = texts.sparkSession.sparkContext.broadcast((bits_of(labels, "begin", size), bits_of(labels, "k1", size)))

    def make():
        tokenizer, (begins, wholes) = Tokenizer(), sets.value

        def among(bits: np.ndarray, hashes: np.ndarray) -> np.ndarray:
            slots = hashes & np.uint64((1 << size) - 1)
            return (bits[(slots >> np.uint64(6)).astype(np.int64)] >> (slots & np.uint64(63))) & np.uint64(1) == 1

        def places(texts: pa.Array) -> pa.Array:
            found = tokenizer.of_texts(texts)
            sizes = found.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
            flat, stops = found.flatten(), np.cumsum(sizes)
            owner, every = np.repeat(np.arange(len(sizes)), sizes), np.arange(len(flat))
            left = stops[owner] - every  # words up to the text's end
            runs, hits = word_hashes(flat.field("text")), []
            for level in range(max(lengths, default=-1) + 1):
                if level in lengths:
                    near = every[(left >= 1 << level) & among(begins, mixed(runs[0], level))]
                    for n in lengths[level]:
                        at = near[left[near] >= n]
                        k1 = run_hash(runs[0], at, n, level)
                        ok = among(wholes, k1)
                        at = at[ok]
                        hits.append((at, np.full(len(at), n), k1[ok], run_hash(runs[1], at, n, level)))
                runs = [doubled(r, level) for r in runs]
            at, n, k1, k2 = (np.concatenate(x) for x in zip(*hits, strict=True)) if hits else (np.zeros(0, t) for t in (np.int64, np.int64, np.uint64, np.uint64))
            if holding is not None:
                names = matches_of(found, holding, "")
                counts = names.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
                first, words = (names.flatten().field(k).to_numpy(zero_copy_only=False) for k in ("first", "words"))
                begin = first + np.repeat(stops - sizes, counts)
                end = np.append(begin + words, len(flat) + 1)
                ok = end[np.searchsorted(begin, at)] <= at + n  # matches come in order and don't overlap, so that the next one ends first
                at, n, k1, k2 = at[ok], n[ok], k1[ok], k2[ok]
            order = np.argsort(at, kind="stable")
            at, n, k1, k2 = at[order], n[order], k1[order], k2[order]
            start, end = (flat.field(k).to_numpy(zero_copy_only=False) for k in ("start", "end"))
            numbers = [pa.array(x.astype(np.int32)) for x in (at - (stops - sizes)[owner[at]], n, start[at], end[at + n - 1])]
            ends = np.concatenate([[0], np.cumsum(np.bincount(owner[at], minlength=len(sizes)))]).astype(np.int32)
            return pa.ListArray.from_arrays(pa.array(ends), pa.StructArray.from_arrays([*numbers, pa.array(k1.view(np.int64)), pa.array(k2.view(np.int64))], fields=list(_PLACE)))

        return places

    whole = texts.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).where("doc_id IS NOT NULL")
    return exploded(whole, ["doc_id"], F.col("text"), Once(make), PLACES)


def at_labels(places: DataFrame, labels: DataFrame, how: str = "inner") -> DataFrame:
    """Places joined to the labels (``keyed``) of their words, or, as a semi-join, those that have one."""
    key = ["k1", "k2", "words"]
    labels = labels.select(*key, "entity", "label", "weight") if how == "inner" else labels.select(*key).distinct()
    n, size = labels.agg(F.count("*"), F.sum(F.length("label") if how == "inner" else F.lit(24))).first()
    if n <= SENT and (size or 0) <= CHARACTERS:
        return places.join(F.broadcast(labels), key, how)
    dealt = places.withColumn("_part", F.pmod(F.hash("doc_id", "first"), F.lit(PARTS)))
    return dealt.join(labels.withColumn("_part", F.explode(F.sequence(F.lit(0), F.lit(PARTS - 1)))), [*key, "_part"], how).drop("_part")


def label_matches(texts: DataFrame, id_col: str, text_col: str, labels: DataFrame) -> DataFrame:
    """``doc_id``, ``entity``, ``label``, ``weight``, ``first`` and ``words`` (number of the first word, count), ``start``, ``end``: every place where all words of a label (of ``labelled``) stand in order.

    Words are equal by 128 bits of hash. Neither words nor texts are shuffled: places are told where the text is, and only they
    meet the labels. Matches may overlap; no text and no label meets all of the others. Identifiers are unique.
    """
    labels = keyed(labels)
    return at_labels(label_places(texts, id_col, text_col, labels), labels).select("doc_id", "entity", "label", "weight", "first", "words", "start", "end")
