"""Mixing sources to target weights: repetition rates from token totals, whole copies plus one hash-seeded Bernoulli copy."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from facetry.llm.texts import checkpointed, word_count

#: Weights that sources take in turn, in the order of their names.
CYCLE = (3, 1, 2)
SHARE = 1.5
MOST = 2.0
SEED = "mix-1"
#: Up to so many sources, the source table is broadcast; beyond, it is joined on salted keys.
BROADCAST_SOURCES = 2000
SALTS = 16


def coin(key: Column, seed: str = SEED) -> Column:
    """A number from 0 to under 1 from the first 52 bits of the md5 of seed and key: equal keys throw equal coins, reruns agree."""
    return F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit("null")))), 1, 13), 16, 10).cast("long") / F.lit(float(1 << 52))


def ranked(sources: DataFrame) -> DataFrame:
    """Adds ``rank``, the position by code point of the source, null last. A distributed sort; only a row a partition reaches the driver."""
    rows = checkpointed(sources.orderBy(F.col("source").isNull(), "source").select("*", F.monotonically_increasing_id().alias("at")))
    part, row = F.shiftright("at", 33), F.col("at").bitwiseAND((1 << 33) - 1)
    before, offset = {}, 0
    for p, n in sorted(rows.groupBy(part.alias("p")).agg(F.count("*").alias("n")).collect()):  # as many as the sort's partitions
        before[p], offset = offset, offset + n
    if not before:
        return rows.select(*sources.columns, F.lit(0).cast("long").alias("rank"))
    starts = F.create_map(*(F.lit(x) for pair in before.items() for x in pair))
    return rows.select(*sources.columns, (row + starts[part]).cast("long").alias("rank"))


def cyclic_weights(sources: DataFrame, cycle: tuple[float, ...] = CYCLE) -> DataFrame:
    """Adds ``weight``: the cycle's values in turn along the ranks."""
    return ranked(sources).withColumn("weight", F.element_at(F.array(*(F.lit(float(x)) for x in cycle)), (F.col("rank") % len(cycle) + 1).cast("int"))).drop("rank")


def targets(sources: DataFrame, share: float = SHARE, most: float = MOST) -> DataFrame:
    """Adds ``target``: the weights' shares of ``share`` times all sizes, each at most ``most`` times its size.

    What exceeds a limit is shared again by weight among the others until none is above. Each round is one sum over the
    sources; the driver holds three numbers. Sources of size 0 get 0.
    """
    sources = checkpointed(sources)
    limit = F.col("source_size") * most
    total = sources.agg(F.sum("source_size")).first()[0] or 0
    full = F.lit(False)
    level, before = 0.0, -1
    while True:
        held, n, free = sources.agg(F.sum(F.when(full, limit).otherwise(0.0)), F.sum(F.when(full, 1).otherwise(0)), F.sum(F.when(full, 0.0).otherwise(F.col("weight")))).first()
        if not n and not free or n == before or not free:
            break
        level, before = (share * total - held) / free, n
        full = limit < F.col("weight") * level
    return sources.withColumn("target", F.when(F.col("weight") * level > limit, limit).otherwise(F.col("weight") * level))


def with_sources(docs: DataFrame, sources: DataFrame, n_sources: int) -> DataFrame:
    """Joins each document's source row, null matching null. One source may hold a third of all rows: a large table joins on salted keys."""
    same = F.col("d.source").eqNullSafe(F.col("s.source"))
    rest = ["s.source_size", "s.weight", "s.target"]
    if n_sources <= BROADCAST_SOURCES:
        return docs.alias("d").join(F.broadcast(sources.alias("s")), same).select("d.*", *rest)
    salted = sources.withColumn("salt", F.explode(F.array(*(F.lit(i) for i in range(SALTS)))))
    left = docs.withColumn("salt", F.pmod(F.xxhash64(*docs.columns), F.lit(SALTS)).cast("int"))
    return left.alias("d").join(salted.alias("s"), same & (F.col("d.salt") == F.col("s.salt"))).select(*(f"d.{c}" for c in docs.columns), *rest)


def copies(key: Column, rate: Column, seed: str = SEED) -> Column:
    """floor(rate) copies, and one more with the probability of the fraction."""
    return (F.floor(rate) + F.when(coin(key, seed) < rate - F.floor(rate), 1).otherwise(0)).cast("long")


def mix_plan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", carry: tuple[str, ...] = ()) -> DataFrame:
    """For each document its size in words, its source's size, target and rate, and ``copies``, how often the mix takes it.

    A null text has size 0; a null source is a source of its own. Rows that repeat an identifier throw the same coin. An
    empty table gives no rows.
    """
    sized = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{source_col}`").cast("string").alias("source"), word_count(F.col(f"`{text_col}`").cast("string")).alias("size"), *(F.col(f"`{c}`").alias(f"row_{i}") for i, c in enumerate(carry)))
    sources = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    table = targets(cyclic_weights(sources))
    out = with_sources(sized, table, table.count())
    rate = F.when(F.col("source_size") > 0, F.least(F.col("target") / F.col("source_size"), F.lit(MOST))).otherwise(0.0)
    return out.withColumn("rate", rate).withColumn("copies", copies(F.col("doc_id"), rate))


def mixed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """The mix itself: every column of the documents, each row as often as ``mix_plan`` takes it."""
    plan = mix_plan(docs, id_col, text_col, source_col, carry=tuple(docs.columns))
    rows = plan.where(F.col("copies") > 0).withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))))
    return rows.select(*(F.col(f"row_{i}").alias(c) for i, c in enumerate(docs.columns)))


#: The plan's numbers in DuckDB SQL, over a relation {docs} of doc_id, source and size: ranks, then the limits reached in order of limit over weight.
PLAN_SQL = """
  src AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM {docs} GROUP BY source),
  weighed AS (SELECT *, CASE (row_number() OVER (ORDER BY source IS NULL, source) - 1) % 3 WHEN 0 THEN 3.0 WHEN 1 THEN 1.0 ELSE 2.0 END::DOUBLE AS weight FROM src),
  steps AS (SELECT *, coalesce(sum(2.0 * source_size) OVER before, 0)::DOUBLE AS held, (SELECT sum(weight) FROM weighed) - coalesce(sum(weight) OVER before, 0) AS free,
      1.5 * (SELECT sum(source_size) FROM weighed)::DOUBLE AS total, row_number() OVER (ORDER BY 2.0 * source_size / weight, source) AS rn FROM weighed WINDOW before AS (ORDER BY 2.0 * source_size / weight, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
  lvl AS (SELECT arg_min((total - held) / free, rn) FILTER (WHERE 2.0 * source_size >= weight * ((total - held) / free)) AS level FROM steps),
  goals AS (SELECT source, source_size, weight, least(2.0 * source_size, weight * level)::DOUBLE AS target FROM weighed, lvl),
  rated AS (SELECT d.*, g.source_size, g.target, CASE WHEN g.source_size > 0 THEN least(g.target / g.source_size, 2.0) ELSE 0 END AS rate FROM {docs} d JOIN goals g ON d.source IS NOT DISTINCT FROM g.source),
  planned AS (SELECT *, CAST(floor(rate) AS BIGINT) + CASE WHEN ('0x' || substr(md5('mix-1:' || coalesce(CAST(doc_id AS VARCHAR), 'null')), 1, 13))::BIGINT / 4503599627370496.0::DOUBLE < rate - floor(rate) THEN 1 ELSE 0 END AS copies FROM rated)
"""
