"""Empty tables, null rows and clashing extra columns, for every operator and pipeline stage."""

import corpus_pipeline
import pytest
from helpers import FOLDER, SCHEMA, documents
from pyspark.sql import functions as F

from facetry.llm import fertility, hnsw, language, lengths, mixing, mixing_lm, pieces, quality, queries, simhash, suffixes

#: Names that the operators use inside.
CLASHES = ("row_0", "part", "bits", "h", "label", "score", "copies", "size", "rank", "_gone", "learn", "block", "k1", "kept", "component_id")


def operators(docs):
    labels = docs.sparkSession.createDataFrame([(1, 1), (2, 0), (None, 1), (4, None)], "doc_id long, quality int")
    model = quality.fit_quality(docs, labels)
    measured = fertility.measure(docs)
    return {
        "fertility": fertility.fertility_rules(measured, fertility.bands(measured)),
        "mix": mixing.mixed(docs),
        "quality": quality.score_quality(docs, model),
        "kept": quality.high_quality(docs, model),
        "language": language.identify(docs, language.fit_codes(docs)),
        "simhash": simhash.near_groups(docs),
        "first": simhash.first_of_groups(docs),
        "suffixes": suffixes.without_repeats(docs),
        "pieces": pieces.encode_pieces(docs),
        "lm": mixing_lm.score_texts(docs, mixing_lm.learnable()),
        "lengths": lengths.length_table(lengths.length_histogram(lengths.encoded_lengths(docs))),
    }


def test_empty_tables(spark):
    docs = spark.createDataFrame([], SCHEMA)
    assert {k: f.count() for k, f in operators(docs).items()} == dict.fromkeys(operators(docs), 0)
    assert hnsw.embedding_groups(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0


def test_null_rows_and_clashing_columns(spark):
    docs = documents(spark, [(None, None, None, None), (1, None, None, "x"), (2, "", "en", None), (3, "some words in a text", "en", "x"), (3, "some words in a text", "en", "x"), (4, "word " * 3000, "de", "y")])
    for name in CLASHES:
        docs = docs.withColumn(name, F.lit("extra"))
    n = docs.count()
    found = operators(docs)
    for name in ("fertility", "quality", "language", "simhash", "suffixes", "pieces", "lm"):
        assert found[name].count() == n, name
    for name in ("kept", "first", "mix"):
        assert found[name].columns == docs.columns and all(r.h == "extra" for r in found[name].collect()), name


@pytest.mark.parametrize("k", range(len(corpus_pipeline.STAGES)))
def test_stages_take_nulls_and_nothing(spark, k):
    stage = corpus_pipeline.STAGES[k][1]
    for docs in (documents(spark, [(None, None, None, None), (1, None, None, "x"), (2, ""), (3, "a b"), (3, "a b")]), spark.createDataFrame([], SCHEMA)):
        out = stage(spark, docs, FOLDER)
        rows = out.collect()
        if k < len(corpus_pipeline.STAGES) - 1:
            assert out.columns == docs.columns
        if not docs.count():
            assert not rows


def test_queries_are_registered():
    assert sorted(int(k[2:].split("_")[0]) for k in queries.queries()) == list(range(1, 14))
