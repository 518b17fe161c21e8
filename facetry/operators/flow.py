"""Dataflow operators: expansion with and without loss, batches, bounded and fixpoint loops, ordered pruning."""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Callable
from functools import reduce

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from facetry.operators.durable import durable
from facetry.operators.spans import marked


def opt_map(rows: DataFrame, **columns: Column) -> DataFrame:
    """Maps to new columns and drops rows in which one is missing."""
    return rows.select(*(c.alias(k) for k, c in columns.items())).dropna()


def bag_map(rows: DataFrame, values: Column, name: str = "value") -> DataFrame:
    """A row for each value of an array; empty and null arrays vanish."""
    return rows.withColumn(name, F.explode(values))


def batched(rows: DataFrame, n: int, *keys: str, order: list[Column | str]) -> DataFrame:
    """Adds ``batch``, a number for each n rows in order within the keys; of all rows in order, without keys."""
    return numbered(rows, *keys, order=order).withColumn("batch", F.floor(F.col("_number") / n).cast("long")).drop("_number")


#: Rows of a key that one task sorts and numbers; more frequent keys are dealt out.
HOT = 1_000_000


def numbered(rows: DataFrame, *keys: str, order: list[Column | str]) -> DataFrame:
    """Adds ``_number``, a row's place, from 0 on, in order within the keys. Keys of up to HOT rows are one window each, others fall into many tasks."""
    if not keys:
        return dealt_numbers(rows, order=order)
    window = lambda few: few.withColumn("_number", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)).cast("long") - 1)
    hot = durable(rows.groupBy(*keys).count().where(F.col("count") > HOT).select(*keys))
    if hot.isEmpty():
        return window(rows)
    same = reduce(lambda a, b: a & b, (F.col(f"rows.{k}").eqNullSafe(F.col(f"hot.{k}")) for k in keys))
    split = lambda how: rows.alias("rows").join(hot.alias("hot"), same, how)
    return window(split("left_anti")).unionByName(dealt_numbers(split("left_semi"), *keys, order=order))


def dealt_numbers(rows: DataFrame, *keys: str, order: list[Column | str]) -> DataFrame:
    """``numbered``, for keys however frequent.

    Rows are dealt out by ranges of keys and order; what a part leaves to the next is its last key and that key's rows in it: a
    row a part goes to the driver.
    """
    spark = rows.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = durable(rows.repartitionByRange(parts, *keys, *order).sortWithinPartitions(*keys, *order))
    told = dealt.select(F.spark_partition_id().alias("part"), F.lit(0).cast("long").alias("n"), *keys).schema
    schema = dealt.select("*", F.lit(0).cast("long").alias("_number")).schema

    def of(batch: pa.RecordBatch):
        return zip(*(batch[k].to_pylist() for k in keys), strict=True) if keys else ((),) * batch.num_rows

    def last(batches):
        key, n = None, 0
        for batch in batches:
            for k in of(batch):
                key, n = k, n + 1 if k == key else 1
        if n:
            yield pa.RecordBatch.from_arrays([pa.array([x], f.type) for x, f in zip((TaskContext.get().partitionId(), n, *key), to_arrow_schema(told), strict=True)], schema=to_arrow_schema(told))

    before, key, n = {}, None, 0
    for r in sorted(dealt.select(*keys).mapInArrow(last, told).collect() if keys else dealt.select(F.lit(0)).mapInArrow(last, told).collect(), key=lambda r: r.part):
        before[r.part] = key, n
        mine = tuple(r[k] for k in keys)
        key, n = mine, r.n + (n if mine == key else 0)

    def number(batches):
        key, n = before.get(TaskContext.get().partitionId(), (None, 0))
        for batch in batches:
            out = []
            for k in of(batch):
                key, n = k, n + 1 if k == key else 1
                out.append(n - 1)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.int64())], schema=to_arrow_schema(schema))

    return dealt.mapInArrow(number, schema)


def iterated(rows: DataFrame, n: int, step: Callable[[DataFrame], DataFrame]) -> DataFrame:
    for _ in range(n):
        rows = step(rows)
    return rows


class Grown:
    """A set of rows that grows: what is new is written once, and all parts are written together when there are many."""

    def __init__(self, rows: DataFrame, most: int = 16):
        self.parts, self.most = [durable(rows.distinct())], most
        self.fresh = self.parts[0]

    def all(self) -> DataFrame:
        return reduce(DataFrame.unionByName, self.parts)

    def grow(self, rows: DataFrame) -> bool:
        """Adds the rows that aren't known; whether there are any."""
        known = self.all()
        same = reduce(lambda a, b: a & b, (F.col(f"new.{c}").eqNullSafe(F.col(f"known.{c}")) for c in known.columns))
        self.fresh = durable(rows.select(known.columns).distinct().alias("new").join(known.alias("known"), same, "left_anti"))
        if self.fresh.isEmpty():
            return False
        self.parts = [*self.parts, self.fresh] if len(self.parts) < self.most else [durable(self.all().unionByName(self.fresh))]
        return True


def looped(rows: DataFrame, step: Callable[[DataFrame], DataFrame], most: int | None = None) -> DataFrame:
    """All rows reached from the first by repeating a step, each once; what is known is not expanded again. ``most`` steps without an end are an error, if given."""
    found, steps = Grown(rows), 0
    while found.grow(step(found.fresh)):
        steps += 1
        if most is not None and steps >= most:
            raise RuntimeError(f"no end after {most} steps")
    return found.all()


def pruned(rows: DataFrame, key: str, start: str, end: str) -> DataFrame:
    """Within each key keeps intervals greedily: the longest first, then the earliest, then in the order of the other columns, if none kept overlaps.

    A key falls into clusters of intervals that overlap in a chain, which don't touch each other: only a cluster meets in one
    task, not a key, and an interval alone in its cluster is kept at once. The others come sorted, many clusters a batch; those kept of a cluster stay
    sorted, so that an interval is compared with its two neighbours only. Intervals without a start or an end overlap nothing.
    """
    found = marked(rows, key, start, end, "_cluster")
    others = [c for c in rows.columns if c not in (key, start, end)]
    order = [key, "_cluster", (F.col(end) - F.col(start)).desc(), start, end, *others]
    rest = found.where("NOT _alone").drop("_alone").repartition(key, "_cluster").sortWithinPartitions(*order)

    def keep(batches):
        cluster, starts, ends = None, [], []
        for batch in batches:
            chosen = []
            for k, c, s, e in zip(*(batch[n].to_pylist() for n in (key, "_cluster", start, end)), strict=True):
                if cluster != (k, c):
                    cluster, starts, ends = (k, c), [], []
                at = bisect_right(starts, s)
                chosen.append((not at or ends[at - 1] <= s) and (at == len(starts) or e <= starts[at]))
                if chosen[-1]:
                    starts.insert(at, s)
                    ends.insert(at, e)
            yield batch.filter(pa.array(chosen, pa.bool_()))

    return found.where("_alone").select(rows.columns).unionByName(rest.mapInArrow(keep, rest.schema).select(rows.columns))


def grouped(rows: DataFrame, key: Column, *values: str, name: str = "values") -> DataFrame:
    """For each key the sorted set of its rows' values, which must fit a row."""
    return rows.groupBy(key).agg(F.sort_array(F.collect_set(F.struct(*values) if len(values) > 1 else F.col(values[0]))).alias(name))
