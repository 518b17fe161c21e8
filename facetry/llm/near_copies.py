"""Near copies: documents whose fingerprints link, or whose sets of five-word shingles have a Jaccard similarity of 0.8 or more.

Four of 64 bits mean a similarity of about 0.95. So the links of fingerprints are joined by those of shingle sets: bands of
least hashes find the candidates (a pair at 0.8 shares one of 24 bands of 5 in 0.9999 of cases, at more in more), and each
candidate is verified on the two whole sets.
"""

from __future__ import annotations

from functools import cache

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from facetry.llm.components import connected_components
from facetry.llm.simhash import fingerprint, fingerprint_links
from facetry.llm.suffixes import mixed
from facetry.llm.texts import MOST_SENT, checkpointed, map_rows, numbered

#: Words of a shingle; bands, and least hashes in each.
WORDS, BANDS, ROWS = 5, 24, 5
#: Hashes handled at once; pairs of one text, or texts of one band, that are dealt to one task, about.
PIECE, HOT = 1 << 16, 300
_ODD = np.random.default_rng(23).integers(1 << 63, size=WORDS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


@cache
def orders() -> tuple[np.ndarray, np.ndarray]:
    random = np.random.default_rng(29)
    return random.integers(1 << 63, size=BANDS * ROWS, dtype=np.uint64), random.integers(1 << 63, size=BANDS * ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def shingles(text: bytes) -> np.ndarray:
    """The distinct hashes, sorted, of all runs of five words of the text with A-Z lower-cased; of all its words if there are fewer."""
    from xxhash import xxh64_intdigest

    words = np.array([xxh64_intdigest(w) for w in text.lower().split()], np.uint64)
    if not len(words):
        return words
    n = min(len(words), WORDS)
    sums = np.full(len(words) - n + 1, n, np.uint64)
    for k in range(n):
        sums += words[k : k + len(sums)] * _ODD[k]
    return np.unique(mixed(sums))


def bands_of(sets: list[np.ndarray]) -> np.ndarray:
    """The bands of least hashes of sets that aren't empty, a row for each."""
    out = np.zeros((len(sets), BANDS), np.uint64)
    flip, times = orders()
    sizes = np.cumsum([len(s) for s in sets])
    at = 0
    while at < len(sets):
        end = max(at + 1, int(np.searchsorted(sizes, (sizes[at - 1] if at else 0) + PIECE, side="right")))
        h = np.concatenate(sets[at:end])
        starts = np.append(0, np.cumsum([len(s) for s in sets[at : end - 1]])).astype(np.int64)
        work = np.empty_like(h)
        for i in range(BANDS * ROWS):
            np.bitwise_xor(h, flip[i], out=work)
            np.multiply(work, times[i], out=work)
            band = out[at:end, i // ROWS]
            band += np.minimum.reduceat(work, starts)
            band[:] = mixed(band + np.uint64(i))
        at = end
    return out


def described(rows: DataFrame) -> DataFrame:
    """``row``, ``doc_id``, the fingerprint ``bits``, and the number ``n``, hash ``node`` and packed ``bands`` of the shingles; null without a word."""

    def make():
        from xxhash import xxh64_intdigest

        def each(batch):
            texts = [t or b"" for t in batch["text"].to_pylist()]
            sets = [shingles(t) for t in texts]
            bands = iter(bands_of([s for s in sets if len(s)]))
            return {
                "row": batch["row"],
                "doc_id": batch["doc_id"],
                "bits": np.array([fingerprint(t) for t in texts], np.uint64).view(np.int64),
                "n": [len(s) for s in sets],
                "node": [xxh64_intdigest(s.tobytes()) - (1 << 63) if len(s) else None for s in sets],
                "bands": [next(bands).view(np.int64).tolist() if len(s) else None for s in sets],
            }

        return each

    return map_rows(rows, make, f"row long, doc_id {rows.schema['doc_id'].dataType.simpleString()}, bits long, n long, node long, bands array<long>")


def rows_of(table: DataFrame, rows: DataFrame) -> DataFrame:
    """The rows of a numbered table that ``rows`` names, by a bit for each row of a bucket of rows.

    Up to MOST_SENT bytes of bits are sent to all tasks, so that texts aren't shuffled; beyond that both sides are dealt out by bucket.
    """
    maps = checkpointed(rows.groupBy(F.bitmap_bucket_number("row").alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("row")).alias("bits_of")))
    size = maps.agg(F.sum(F.length("bits_of"))).first()[0] or 0
    place = F.bitmap_bit_position("row")
    byte = F.conv(F.hex(F.substring("bits_of", F.floor(place / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    marked = table.withColumn("bucket", F.bitmap_bucket_number("row")).join(maps.hint("broadcast" if size <= MOST_SENT else "merge"), "bucket")
    return marked.where(byte.bitwiseAND(F.element_at(F.array(*(F.lit(1 << k) for k in range(8))), (place % 8 + 1).cast("int"))) != 0).drop("bucket", "bits_of")


def sets_of(texts: DataFrame, wanted: DataFrame) -> DataFrame:
    def make():
        return lambda batch: {"row": batch["row"], "shingles": [shingles(t or b"").tobytes() for t in batch["text"].to_pylist()]}

    return map_rows(rows_of(texts, wanted).select("row", "text"), make, "row long, shingles binary")


def verified(sets: DataFrame, pairs: DataFrame) -> DataFrame:
    """Of the pairs ``a``, ``b`` of rows those whose shingle sets have a Jaccard similarity of 0.8 or more."""
    salts = pairs.groupBy("a").agg(F.ceil(F.count("*") / HOT).cast("int").alias("salts"))  # a hub's set goes to as many tasks as its pairs need
    left = sets.join(salts.withColumnRenamed("a", "row"), "row").select(F.col("row").alias("a"), F.col("shingles").alias("x"), F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"))
    dealt = pairs.join(salts, "a").select("a", "b", F.pmod(F.xxhash64("b"), F.col("salts")).cast("int").alias("salt"))
    both = dealt.join(left, ["a", "salt"]).join(sets.select(F.col("row").alias("b"), F.col("shingles").alias("y")), "b")

    def alike():
        def each(batch):
            x, y = ([np.frombuffer(s, np.uint64) for s in batch[k].to_pylist()] for k in ("x", "y"))
            ok = np.array([9 * len(np.intersect1d(p, q, assume_unique=True)) >= 4 * (len(p) + len(q)) for p, q in zip(x, y, strict=True)], bool)
            return {k: batch[k].take(_indices(np.flatnonzero(ok))) for k in ("a", "b")}

        return each

    return map_rows(both.select("a", "b", "x", "y"), alike, "a long, b long")


def _indices(where: np.ndarray):
    import pyarrow as pa

    return pa.array(where, pa.int64())


def of_like_size(x: str, y: str):
    return 5 * F.least(x, y) >= 4 * F.greatest(x, y)


def alike_links(texts: DataFrame, nodes: DataFrame) -> DataFrame:
    """Links ``a``, ``b`` that connect all ``nodes`` (``unit``, a row of the texts, ``n`` and ``bands``) at a similarity of 0.8 or more that share a band.

    First each text is compared with two leaders of each of its bands. Then texts of a band that these links leave apart are, in blocks.
    One leader is the least of three orders, so that bands of the same texts mostly have the same. The other is the text whose
    bands hold the most texts: of many changed copies of one text, which may be less like each other, that is the text itself.
    """
    keys = nodes.select("unit", F.col("n").cast("int").alias("n"), F.explode("bands").alias("key"))
    least = F.min(F.struct(F.xxhash64("unit", F.pmod("key", F.lit(3))), "unit", "n"))
    bands = keys.groupBy("key").agg(F.count("*").alias("times"), least.alias("least")).where("times > 1")  # summed before they are shuffled
    keys = checkpointed(keys.join(bands, "key"))
    central = keys.groupBy("unit").agg(F.sum("times").alias("met"))
    middle = keys.join(central, "unit").groupBy("key").agg(F.max(F.struct("met", -F.col("unit"), "n")).alias("middle"))
    leaders = keys.join(middle.select("key", (-F.col("middle.col2")).alias("middle"), F.col("middle.n").alias("middle_n")), "key")
    sets = checkpointed(sets_of(texts, keys.select(F.col("unit").alias("row")).distinct()))
    led = leaders.select("unit", "n", F.inline(F.array(F.struct(F.col("least.unit").alias("leader"), F.col("least.n").alias("leader_n")), F.struct(F.col("middle").alias("leader"), F.col("middle_n").alias("leader_n")))))
    keys = keys.drop("least")
    tried = checkpointed(led.where((F.col("unit") != F.col("leader")) & of_like_size("n", "leader_n")).select(F.least("leader", "unit").alias("a"), F.greatest("leader", "unit").alias("b")).distinct())
    first = checkpointed(verified(sets, tried))
    labels = connected_components(first).toDF("unit", "label")
    labelled = keys.join(labels, "unit", "left").select("key", "unit", "n", "times", F.coalesce("label", "unit").alias("label"))
    apart = labelled.groupBy("key").agg(F.min("label").alias("low"), F.max("label").alias("high")).where("low != high").select("key")
    rest = labelled.join(apart, "key").select("key", "unit", "times", "label")
    return first.union(band_links(rest, sets.join(nodes.select(F.col("unit").alias("row"), "bands"), "row").withColumnRenamed("row", "unit")))


def band_links(rest: DataFrame, texts: DataFrame) -> DataFrame:
    """Links ``a``, ``b`` of texts (``unit``, ``shingles``, ``bands``) of different labels that share a band (``key``, ``unit``, ``times``, ``label``).

    A band's texts are dealt out to blocks of about HOT; two blocks meet in a task, which compares their texts in place and gives the links
    alone. Pairs are neither written nor shuffled, and are compared in the first band that they share.
    """
    blocks = F.ceil(F.col("times") / HOT).cast("int")
    rows = rest.withColumn("own", F.pmod(F.xxhash64("unit"), blocks).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), blocks - 1)))
    rows = rows.select("key", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "unit", "label").join(texts, "unit")

    def compared(key, table):
        import pyarrow as pa

        band, i, j = (k.as_py() for k in key)
        sets = [np.frombuffer(x, np.uint64) for x in table["shingles"].to_pylist()]
        size, units, own, label = np.array([len(x) for x in sets]), *(table[k].to_numpy() for k in ("unit", "own", "label"))
        bands = np.array(table["bands"].to_pylist(), np.int64)
        ids = np.unique(np.concatenate(sets), return_inverse=True)[1]
        ends = np.cumsum(size)
        has, found = np.zeros(int(ids.max()) + 1, np.int32), []
        order = np.arange(len(units))
        for x in np.flatnonzero(own == i).tolist():
            near = (label != label[x]) & (5 * np.minimum(size, size[x]) >= 4 * np.maximum(size, size[x])) & ((order > x) if i == j else (own == j))
            if near.any():
                common = bands == bands[x]
                near &= bands[x][common.argmax(axis=1)] == band  # the first band that both have
            if near.any():
                mine = ids[ends[x] - size[x] : ends[x]]
                has[mine] = 1
                both = np.add.reduceat(has[ids], ends - size)
                has[mine] = 0
                found += [(units[x], units[y]) for y in np.flatnonzero(near & (9 * both >= 4 * (size + size[x]))).tolist()]
        pairs = np.array(found, np.int64).reshape(-1, 2)
        return pa.table({"a": pa.array(pairs.min(axis=1)), "b": pa.array(pairs.max(axis=1))})

    return rows.groupBy("key", "i", "j").applyInArrow(compared, "a long, b long")


def first_of_near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row, all its columns, of each group of rows linked by fingerprints at 4 or fewer differing bits or by shingle sets.

    It is that of the smallest identifier, a null one being the greatest. Groups are of rows, not of identifiers: a row whose
    identifier repeats elsewhere stays or goes by its own text.
    """
    table = numbered(docs)
    texts = table.select("row", F.col("of").getField(id_col).alias("doc_id"), F.col("of").getField(text_col).cast("string").cast("binary").alias("text"))
    first = F.min(F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "row")).alias("first")
    units = checkpointed(described(texts).groupBy("bits", "node").agg(F.min("row").alias("unit"), first, F.first("n").alias("n"), F.first("bands").alias("bands")))
    bits, nodes = units.groupBy("bits").agg(F.min("unit").alias("b")), units.where("node is not null").groupBy("node").agg(F.min("unit").alias("b"), F.first("n").alias("n"), F.first("bands").alias("bands"))
    bits = checkpointed(bits)
    pairs = fingerprint_links(bits, bits.count()).toDF("x", "y")
    pairs = pairs.join(bits.toDF("x", "a"), "x").join(bits.toDF("y", "b"), "y").select("a", "b")
    same = units.join(bits, "bits").select(F.col("unit").alias("a"), "b").union(units.join(nodes, "node").select(F.col("unit").alias("a"), "b"))
    alike = alike_links(texts, checkpointed(nodes.select(F.col("b").alias("unit"), "n", "bands")))
    groups = connected_components(pairs.union(same).union(alike)).toDF("unit", "group")
    chosen = units.join(groups, "unit", "left").groupBy(F.coalesce("group", "unit").alias("group")).agg(F.min("first").alias("first")).select(F.col("first.row").alias("row"))
    return rows_of(table, chosen).select(*(F.col("of").getField(c).alias(c) for c in docs.columns))
