"""A mirror kept by batches and streams; numbers within keys over many parts; templates."""

import random

import pytest
from pyspark.sql import functions as F

from facetry.functions import text as fn
from facetry.operators import flow
from facetry.streaming import mirror as mr

SCHEMA = "item long, version long, gone boolean, text string"


def newest(changes):
    best = {}
    for item, version, gone, text in changes:
        if item is not None and version is not None and (item not in best or (version, gone, text) > best[item]):
            best[item] = (version, gone, text)
    return sorted((k, v[0], v[2]) for k, v in best.items() if not v[1])


def state(mirror):
    return sorted(map(tuple, mirror.items().collect()))


def test_batches_and_replays(spark, tmp_path):
    random.seed(2)
    mirror = mr.Mirror(spark, f"file://{tmp_path}/m", "item", "version", "gone", buckets=5)
    assert mirror.items() is None
    taken = []
    for batch in range(4):
        rows = [(random.randint(0, 12), random.randint(0, 30), random.random() < 0.2, f"t{random.randint(0, 9)}") for _ in range(15)] + [(None, 1, False, "x"), (3, None, False, "y")]
        taken += rows
        frame = spark.createDataFrame(rows, SCHEMA)
        assert mirror.apply(frame, batch) and state(mirror) == newest(taken)
        kept = mirror.current()
        assert not mirror.apply(spark.createDataFrame([(1, 99, False, "again")], SCHEMA), batch) and not mirror.apply(frame, 0)
        assert mirror.current() == kept and state(mirror) == newest(taken)
    assert mirror.apply(spark.createDataFrame([], SCHEMA), 4) and state(mirror) == newest(taken)


def test_a_swap_that_breaks_off_leaves_the_old_state(spark, tmp_path, monkeypatch):
    mirror = mr.Mirror(spark, f"file://{tmp_path}/m", "item", "version", "gone")
    mirror.apply(spark.createDataFrame([(1, 1, False, "old"), (2, 1, False, "same")], SCHEMA), 0)

    def fail(*_):
        raise OSError("lost")

    with monkeypatch.context() as m, pytest.raises(OSError):
        m.setattr(mr.Mirror, "_point", fail)
        mirror.apply(spark.createDataFrame([(1, 2, False, "new")], SCHEMA), 1)
    assert state(mirror) == [(1, 1, "old"), (2, 1, "same")]
    assert mirror.apply(spark.createDataFrame([(1, 2, False, "new")], SCHEMA), 1)
    assert state(mirror) == [(1, 2, "new"), (2, 1, "same")]


def test_a_stream_goes_on_where_it_stopped(spark, tmp_path):
    mirror = mr.Mirror(spark, f"file://{tmp_path}/m", "item", "version", "gone")
    taken = []
    for k in range(3):
        rows = [(i, k * 10 + i % 3, (i + k) % 5 == 0, f"t{k}") for i in range(6)]
        taken += rows
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
        mirror.follow(stream, f"{tmp_path}/progress").awaitTermination()
        assert state(mirror) == newest(taken)


def test_repeated_changes_of_a_stream(spark, tmp_path):
    rows = [(i % 4, f"2024-01-01 00:0{i % 3}:00") for i in range(12)]
    spark.createDataFrame(rows, "k long, t string").selectExpr("k", "timestamp(t) AS t").coalesce(1).write.parquet(f"{tmp_path}/in")
    table = spark.read.parquet(f"{tmp_path}/in")
    assert mr.once(table, ["k"], "t", "1 hour").count() == 4
    stream = mr.once(spark.readStream.schema(table.schema).parquet(f"{tmp_path}/in"), ["k"], "t", "1 hour")
    stream.writeStream.format("memory").queryName("once").trigger(availableNow=True).start().awaitTermination()
    assert spark.table("once").count() == 4


@pytest.mark.parametrize("hot", [0, 20, 10**6])
def test_numbers_within_keys_over_many_parts(spark, monkeypatch, hot):
    monkeypatch.setattr(flow, "HOT", hot)
    random.seed(4)
    rows = [(random.choice([1, 1, 1, 1, 2, None]), i) for i in random.sample(range(500), 300)]
    frame = spark.createDataFrame(rows, "k long, t long").repartition(5)
    found = {(r.k, r.t): r.batch for r in flow.batched(frame, 7, "k", order=["t"]).collect()}
    for k in (1, 2, None):
        own = sorted(t for x, t in rows if x == k)
        assert [found[k, t] for t in own] == [i // 7 for i in range(len(own))]
    whole = {r.t: r.batch for r in flow.batched(frame, 10, order=[F.col("t").desc()]).collect()}
    assert [whole[t] for t in sorted((t for _, t in rows), reverse=True)] == [i // 10 for i in range(len(rows))]
    assert flow.batched(frame.limit(0), 3, "k", order=["t"]).count() == 0
    grouped = flow.grouped(frame, F.col("k"), "t").collect()
    assert {r[0]: r["values"] for r in grouped} == {k: sorted(t for x, t in rows if x == k) for k in (1, 2, None)}


def test_templates_are_filled_once(spark):
    row = spark.createDataFrame([("{b}", "B c&d", None)], "a string, b string, n long")
    values = {"a": F.col("a"), "b": F.col("b"), "n": F.col("n")}
    told = {"{a}-{b}": "{b}-B c&d", "%{b}": "B+c%26d", r"\{a}{b}": "{a}B c&d", "{n}{x}": "{x}", "plain {": "plain {", "": "", "%{x}": "%{x}"}
    for template, text in told.items():
        assert row.select(fn.filled(template, **values)).first()[0] == text
    each = row.select(fn.filled_each("{a}/%{b}", a=F.array(F.lit("{b}"), F.lit("x")), b=F.array(F.lit("1 2"), F.lit("3")))).first()[0]
    assert each == ["{b}/1+2", "{b}/3", "x/1+2", "x/3"]
    assert row.select(fn.filled_each("{a}", a=F.array().cast("array<string>"))).first()[0] == []
