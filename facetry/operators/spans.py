"""Joins of spans (start, end; the end is outside) within a key, by buckets of places, so that no key is one task."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from functools import reduce

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from facetry.operators.durable import durable

#: How two spans lie: the first holds the second, they share a place, or one ends where the other starts.
TESTS = {
    "contains": lambda a, b, c, d: (a <= c) & (d <= b),
    "intersects": lambda a, b, c, d: (a < d) & (c < b),
    "borders": lambda a, b, c, d: (b == c) | (d == a),
}


def joined(left: DataFrame, right: DataFrame, key: str, how: str, width: int) -> DataFrame:
    """Pairs of rows of one key whose spans lie as asked, once each. Spans without a start or an end pair with nothing.

    Buckets are ``width`` places wide, and twice as wide at each level. A span has the level at which it covers two buckets at
    most, and lies in the buckets of that and of all higher levels that any span has: few rows, however long it is. A pair meets at the
    higher of its levels, in the bucket of the first place (or edge) that both have.
    """
    test: Column = TESTS[how](F.col("start"), F.col("end"), F.col("_start"), F.col("_end"))
    other = right.select(*(F.col(c).alias(c if c == key else f"_{c}") for c in right.columns))
    own = lambda a, b: F.greatest(F.lit(0), F.ceil(F.log2((F.col(b) - F.col(a) + 1) / width))).cast("int")
    left, other = (rows.dropna(subset=[a, b]).withColumn(name, own(a, b)) for rows, a, b, name in ((left, "start", "end", "_own"), (other, "_start", "_end", "_other")))
    levels = sorted(r[0] for r in left.select("_own").union(other.select("_other")).distinct().collect())  # as many as a length has bits
    if not levels:
        levels = [0]
    size = (F.lit(width) * F.pow(F.lit(2.0), F.col("_level"))).cast("long")

    def dealt(rows: DataFrame, a: str, b: str, own: str) -> DataFrame:
        rows = rows.withColumn("_level", F.explode(F.filter(F.array(*map(F.lit, levels)), lambda x: x >= F.col(own))))
        return rows.withColumn("_bucket", F.explode(F.sequence(F.floor(F.col(a) / size), F.floor(F.col(b) / size))))

    found = dealt(left, "start", "end", "_own").join(dealt(other, "_start", "_end", "_other"), [key, "_level", "_bucket"])
    found = found.where((F.col("_level") == F.greatest("_own", "_other")) & test & (F.col("_bucket") == F.floor(F.greatest("start", "_start") / size)))
    return found.drop("_level", "_bucket", "_own", "_other")


def held(left: DataFrame, right: DataFrame, key: str, name: str = "held") -> DataFrame:
    """Adds the number of right rows of the same key whose spans the row's span holds, without making the pairs.

    Those that end by the end, less those that start before the start, and more by those that do neither, which hold the row's
    span with room on both sides and were taken off wrongly. Work grows with the rows times the logarithm of the spans of that last sort.
    """
    outer, inner = (rows.select(key, "start", "end").dropna() for rows in (left, right))
    outer, axes = outer.distinct(), {"end": (2, 1), "start": (0, -1)}
    points = reduce(DataFrame.union, (inner.select(key, F.lit(c).alias("axis"), F.col(c).alias("place")) for c in axes)).groupBy(key, "axis", "place").agg(F.count("*").alias("n"))
    probes = reduce(DataFrame.union, (outer.select(key, F.lit(c).alias("axis"), F.col(c).alias("place"), F.lit(kind).alias("kind"), "start", "end", F.lit(sign).alias("sign")) for c, (kind, sign) in axes.items()))
    signed = below(points, probes, [key, "axis"]).select(key, "start", "end", (F.col("sign") * F.col("_below")).alias("n"))
    if (around := holders(outer, inner, key)) is not None:
        signed = signed.union(around)
    found = signed.groupBy(key, "start", "end").agg(F.sum("n").alias(name))
    return left.join(found, [key, "start", "end"], "left").select(*left.columns, F.coalesce(name, F.lit(0).cast("long")).alias(name))


def holders(outer: DataFrame, inner: DataFrame, key: str) -> DataFrame | None:
    """For outer spans the number of inner ones that start before and end after them; None if no inner span is long enough.

    Starts before a place, by rank, are a few whole blocks of a power of two of ranks, one a bit; ends are counted within each.
    """
    length = F.col("end") - F.col("start")
    inner = durable(inner.join(outer.groupBy(key).agg(F.min(length).alias("_least")), key).where(length >= F.col("_least")).drop("_least"))
    if inner.isEmpty():
        return None
    outer = outer.join(inner.groupBy(key).agg(F.max(length).alias("_most")), key).where(length <= F.col("_most")).drop("_most")
    starts = inner.select(key, F.col("start").alias("place")).distinct().withColumn("n", F.lit(1).cast("long"))
    of = lambda rows, own: rows.select(key, F.col("start").alias("place"), F.lit(0).alias("kind"), "start", "end", F.lit(own).alias("own"))
    ranked = durable(below(starts, of(inner, False).union(of(outer, True)), [key]))
    levels = F.sequence(F.lit(0), F.lit(max(0, int(ranked.agg(F.max("_below")).first()[0] or 0).bit_length() - 1)))
    blocks = ranked.withColumn("level", F.explode(levels)).withColumn("block", F.expr("shiftright(_below, level)")).drop("_below", "place")
    points = blocks.where("NOT own").groupBy(key, "level", "block", (-F.col("end")).alias("place")).agg(F.count("*").alias("n"))
    probes = blocks.where("own AND block % 2 = 1").select(key, "level", (F.col("block") - 1).alias("block"), (-F.col("end")).alias("place"), "kind", "start", "end")
    return below(points, probes, [key, "level", "block"]).select(key, "start", "end", F.col("_below").alias("n"))


def below(points: DataFrame, probes: DataFrame, keys: list[str]) -> DataFrame:
    """Adds to probes ``_below``, the sum of ``n`` of the points of the same keys at a lower ``place``, or also at their own (``kind`` 2 instead of 0).

    Rows are dealt out by ranges of keys and place, so that no key is one task; a part's sums count for the parts after it.
    """
    parts = int(points.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = points.withColumn("kind", F.lit(1)).unionByName(probes.withColumn("n", F.lit(0).cast("long")), allowMissingColumns=True)
    dealt = durable(rows.repartitionByRange(parts, *keys, "place", "kind").withColumn("_part", F.spark_partition_id()))
    before = dealt.groupBy(*keys, "_part").agg(F.sum("n").alias("_sum"))
    before = before.select(*keys, "_part", F.sum("_sum").over(Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)).alias("_before"))
    running = F.sum("n").over(Window.partitionBy(*keys, "_part").orderBy("place", "kind").rowsBetween(Window.unboundedPreceding, 0))
    found = dealt.withColumn("_running", running).where("kind <> 1").join(before, [*keys, "_part"])
    return found.select(*probes.columns, (F.col("_running") + F.coalesce("_before", F.lit(0))).alias("_below"))


def clustered(rows: DataFrame, key: str, start: str, end: str, name: str = "cluster") -> DataFrame:
    """Adds the smallest start that a chain of overlaps within the key leads to; spans of different clusters don't overlap. Spans without a start or an end have no cluster."""
    return marked(rows, key, start, end, name).drop("_alone")


def marked(rows: DataFrame, key: str, start: str, end: str, name: str) -> DataFrame:
    """Adds the cluster, and ``_alone``: the span is known to be the only one of its cluster.

    Rows are dealt out by ranges of key and start, so that a key, however frequent, falls into many tasks. What a part leaves
    to the next one is its last key, that key's greatest end and last cluster: a row a part goes to the driver, no more.
    """
    spark, names = rows.sparkSession, (key, start, end)
    whole = F.col(start).isNotNull() & F.col(end).isNotNull()
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = durable(rows.where(whole).repartitionByRange(n, key, start).sortWithinPartitions(*names))
    told = dealt.select(F.spark_partition_id().alias("part"), F.col(key).alias("key"), F.col(end).alias("most"), F.col(start).alias("first")).schema
    schema = dealt.select("*", F.col(start).alias(name), F.lit(True).alias("_alone")).schema

    def last(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state = None
        for batch in batches:
            for state in running(triples(batch, names), state):  # noqa: B007
                pass
        if state:
            arrow, found = to_arrow_schema(told), [TaskContext.get().partitionId(), *state]
            yield pa.RecordBatch.from_arrays([pa.array([x], f.type) for x, f in zip(found, arrow, strict=True)], schema=arrow)

    left, state = {}, None
    for part, k, most, first in sorted(dealt.select(*names).mapInArrow(last, told).collect(), key=lambda r: r[0]):
        left[part] = state
        if state and state[0] == k:  # the part has this key only, and its last cluster is the one before unless it begins after that
            first, most = (first if first >= state[1] else state[2]), max(most, state[1])
        state = (k, most, first)

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        arrow, state = to_arrow_schema(schema), left.get(TaskContext.get().partitionId())
        for batch in batches:
            before, firsts, new = state, [], []
            for state in running(triples(batch, names), state):  # noqa: B020
                firsts.append(state[2])
                new.append(before is None or (before[0], before[2]) != (state[0], state[2]))
                before = state
            alone = [a and b for a, b in zip(new, [*new[1:], False], strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(firsts, arrow.field(name).type), pa.array(alone)], schema=arrow)

    rest = rows.where(~whole).select("*", F.lit(None).cast(told["first"].dataType).alias(name), F.lit(True).alias("_alone"))
    return dealt.mapInArrow(mark, schema).unionByName(rest)


def triples(batch: pa.RecordBatch, names: tuple[str, ...]) -> Iterator[tuple]:
    return zip(*(batch[n].to_pylist() for n in names), strict=True)


def running(spans: Iterable[tuple], state: tuple | None) -> Iterator[tuple]:
    """For sorted (key, start, end) the key, the greatest end so far and the start of the cluster."""
    for key, start, end in spans:
        if state is None or state[0] != key or start >= state[1]:
            state = (key, end, start)
        elif end > state[1]:
            state = (key, end, state[2])
        yield state
