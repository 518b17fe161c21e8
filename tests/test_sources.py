"""Statements as N-Quads, graph patterns, pages, mixed values and a stream of facets, on small fixtures."""

import pytest
from pyspark.sql import functions as F

from facetry.functions import html, values
from facetry.operators import patterns
from facetry.sources import nquads
from facetry.streaming.facets import windowed_terms


def test_nquads_files_come_back(spark, tmp_path):
    rows = [("g", "a/1", "p", 'a "quoted" \\n text'), (None, "a/2", "p", "line\nbreak\tand \\ slash"), ("g", "a/3", "p", "")]
    nquads.write_nquads(spark.createDataFrame(rows, "graph string, s string, p string, o string"), f"{tmp_path}/q")
    found = nquads.read_nquads(spark, f"{tmp_path}/q").select("graph", "s", "p", "o").collect()
    assert sorted(map(tuple, found), key=lambda r: r[1]) == rows


def test_nquads_terms(spark):
    lines = ["# a comment", "", '_:b <p> "chat"@fr .', '<a> <p> "5"^^<int> <g> .', "<a> <p> <b> .", "not a statement"]
    found = {(r.s, r.o, r.kind, r.lang, r.datatype, r.graph) for r in nquads.parsed(spark.createDataFrame([(x,) for x in lines], "value string")).collect()}
    assert found == {("_:b", "chat", "literal", "fr", None, None), ("a", "5", "literal", None, "int", "g"), ("a", "b", "iri", None, None, None)}


def test_patterns_without_a_common_variable_are_an_error(spark):
    store = spark.createDataFrame([("g", "a", "p", "b"), ("g", "a", "q", "a")], "graph string, s string, p string, o string")
    with pytest.raises(ValueError):
        patterns.group(store, ("?a", "p", "?b"), ("?c", "q", "?d"))
    assert [tuple(r) for r in patterns.matched(store, "?x", "?p", "?x").collect()] == [("a", "q")]
    assert [tuple(r) for r in patterns.along(store, "^p", "q").collect()] == [("b", "a")]


def test_pages_as_text(spark):
    page = "<html><head><title>no</title></head><body><h1>Top</h1><p>One &amp; <b>two</b><br>three</p><ul><li>x</ul><script>no()</script></body></html>"
    found = spark.createDataFrame([(page,), (None,), ("",)], "html string").select(html.untagged("html").alias("t"), html.main_text("html").alias("m")).collect()
    assert [r.t for r in found] == ["# Top\n\nOne & two\nthree\n\n- x", None, ""]
    assert [r.m for r in found] == ["One & two\nthree", None, None]


def test_order_of_mixed_values(spark):
    told = [(None, None), ("blank", "_:b"), ("iri", "a"), ("boolean", "false"), ("number", "-2"), ("number", "10"), ("number", "ten"), ("date", "2020-01-01"), ("string", "a"), ("string", "b")]
    rows = spark.createDataFrame(told[::-1], "kind string, text string")
    assert [tuple(r) for r in rows.orderBy(values.sort_key(F.col("kind"), F.col("text"))).collect()] == told


def test_facets_over_a_stream(spark, tmp_path):
    rows = spark.createDataFrame([(i * 600, "ab"[i % 2]) for i in range(60)], "t long, value string").select(F.timestamp_seconds("t").alias("ts"), "value")
    rows.write.parquet(f"{tmp_path}/in")
    stream = windowed_terms(spark.readStream.schema(rows.schema).parquet(f"{tmp_path}/in"), "ts", "value")
    query = stream.writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True).start()
    query.awaitTermination(60)
    told = {tuple(r) for r in windowed_terms(rows, "ts", "value").collect()}
    found = {tuple(r) for r in spark.read.parquet(f"{tmp_path}/out").collect()}
    assert found and found <= told  # windows that the watermark has passed


def test_quads_of_all_kinds_come_back(spark):
    lines = ['<a> <p> <b> <g> .', '_:x <p> _:y .', '<a> <p> "un \\"mot\\"\\n"@fr <g> .', '<a> <p> "3"^^<int> .', '<a> <p> "plain \\\\u" .']
    rows = nquads.parsed(spark.createDataFrame([(x,) for x in lines], "value string"))
    assert sorted(r.value for r in nquads.formatted(rows).collect()) == sorted(lines)
    found = nquads.parsed(spark.createDataFrame([('<a> <p> "caf\\u00e9 \\\\u0041" .',)], "value string")).collect()
    assert found[0].o == "café \\u0041"
    assert [r.value for r in nquads.one_graph(rows, "g").where("value like '%@fr%'").collect()] == ['<a> <p> "un \\"mot\\"\\n"@fr .']


def test_texts_by_slices_are_those_by_rows(spark):
    from facetry.functions import html, slices, values

    texts = [None, "", "é à", "<p>ü<h1>A</h1>", *("<li>" + "ñ" * k for k in range(200))]
    rows = spark.createDataFrame(list(enumerate(texts)), "k long, text string").coalesce(1)
    for run, whole in ((html.untagged_texts, html.untagged), (html.main_texts, html.main_text), (values.bare_texts, values.without_marks)):
        found = slices.with_column(rows, "text", F.col("text"), run, "string")
        assert found.columns == ["k", "text"] and sorted(found.collect(), key=lambda r: r.k) == sorted(rows.select("k", whole("text").alias("text")).collect(), key=lambda r: r.k)
    batch = rows.toArrow().to_batches()[0]
    parts = list(slices.slices(batch, "text", 1000))
    assert len(parts) > 10 and sum(p.num_rows for p in parts) == batch.num_rows
