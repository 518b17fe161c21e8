"""Terms, names, JSON by paths, cleaned texts."""

import uuid

from pyspark.sql import functions as F

from facetry.functions import terms as tm


def test_kinds_and_types(spark):
    rows = spark.createDataFrame([("iri", "http://x", None, None), ("blank", "b1", None, None), ("literal", "5", "integer", None), ("literal", "five", "integer", None), ("literal", "hi", None, "en"), ("literal", "it's\n", None, None), ("literal", "1.50", "decimal", None), ("literal", "1", "boolean", None), ("iri", "rdf:type", None, None), ("literal", None, None, None)], "kind string, text string, dt string, lang string")
    t = tm.term(F.col("text"), F.col("kind"), F.col("dt"), F.col("lang"))
    rows = rows.select(t.alias("t"))
    t = F.col("t")
    found = rows.select(tm.bound(t), tm.is_iri(t), tm.is_blank(t), tm.is_literal(t), tm.is_numeric(t), tm.type_of(t), tm.lang_of(t), tm.formatted(t), tm.has_type(t, "resource"), tm.has_type(t, "integer")).collect()
    assert [r[0] for r in found] == [True] * 9 + [False]
    assert [r[5] for r in found] == ["iri", "blank", "integer", "integer", "langString", "string", "decimal", "boolean", "iri", None]
    assert [r[4] for r in found][:7] == [False, False, True, False, False, False, True]
    assert [r[7] for r in found] == ["<http://x>", "_:b1", "5", "'five'^^<integer>", "'hi'@en", "'it\\'s\\n'", "'1.50'^^<decimal>", "true", "a", None]
    assert [r[6] for r in found][:5] == [None, None, "", "", "en"] and [r[8] for r in found][:3] == [True, True, False] and [r[9] for r in found][2:4] == [True, True]


def test_conversions(spark):
    texts = ["true", "0", "12", "-1.5", "1e3", "2020-02-30", "2020-02-29", "2020-01-01T10:00:00", "x", "", None]
    rows = spark.createDataFrame([(x,) for x in texts], "text string").select(tm.term(F.col("text")).alias("t"))
    found = {k: [None if r[0] is None else str(r[0]) for r in rows.select(tm.converted(F.col("t"), k)).collect()] for k in ("boolean", "integer", "decimal", "double", "date", "dateTime", "string")}
    assert found["boolean"][:3] == ["True", "False", None] and found["integer"][:4] == [None, "0", "12", None]
    assert found["decimal"][3] == "-1.5000000000" and found["double"][4] == "1000.0" and found["date"][5:8] == [None, "2020-02-29", "2020-01-01"]
    assert found["dateTime"][7] == "2020-01-01 10:00:00" and found["dateTime"][6] is None and found["string"] == texts


def test_names(spark):
    rows = spark.createDataFrame([("http://u@x.y:80/a/b?q=1&r#f?g",), ("mailto:a@b",), ("/rel?x",), ("",), (None,), ("http://schema.org/name",)], "iri string")
    parts = [r[0] and tuple(r[0]) for r in rows.select(tm.iri_parts(F.col("iri"))).collect()]
    assert parts[:4] == [("http", "u@x.y:80", "/a/b", "q=1&r", "f?g"), ("mailto", "", "a@b", "", ""), ("", "", "/rel", "x", ""), ("", "", "", "", "")]
    assert rows.select(tm.vocabulary(F.col("iri"))).collect()[5][0] == "https://schema.org/name"
    for text in ("", "abc", "ünï"):
        found = spark.range(1).select(tm.named_uuid(F.lit(text))).first()[0]
        plain = uuid.UUID(bytes=__import__("hashlib").md5(text.encode()).digest(), version=3)
        assert found == str(plain)
    assert spark.range(1).select(tm.indented(F.lit("a\nb"))).first()[0] == "a\n\tb"


def test_json_by_paths(spark):
    json = '{"a":[{"b":1.9,"c":"x"},{"b":-2.9,"c":null},{"b":"s"}],"0":true,"m":{"x":false,"y":"t","z":[1,[2]]}}'
    rows = spark.createDataFrame([(json,), ("no",), (None,), ("[]",), ("3",)], "j string")
    of = lambda f, path: [r[0] for r in rows.select(f(F.col("j"), path)).collect()]
    assert of(tm.json_integers, "a.*.b") == [[1, -2], None, None, [], []]
    assert of(tm.json_texts, "a.*.*")[0] == ["x", "s"] and of(tm.json_booleans, "0")[0] == [True] and of(tm.json_booleans, "m.*")[0] == [False]
    assert of(tm.json_integers, "m.z.1.0")[0] == [2] and of(tm.json_integers, "m.z.9")[0] == [] and of(tm.json_integers, "")[4] == [3]
    assert float(of(tm.json_decimals, " a . 0 . b ")[0][0]) == 1.9


def test_expressions_and_cleaning(spark):
    rows = spark.createDataFrame([("12-ab",), ("12-ab!",), (None,)], "t string")
    assert [r[0] for r in rows.select(tm.group(F.col("t"), r"(\d+)-(\w+)", 2)).collect()] == ["ab", None, None]
    assert rows.select(tm.results(F.col("t"), r"\d")).first()[0] == ["1", "2"]
    text = "  Á \t  “b”—c…\r\n "
    clean = lambda **k: spark.createDataFrame([(text,), ("",), (None,)], "t string").select(tm.cleaned(F.col("t"), **k)).collect()
    assert [r[0] for r in clean()] == ["Á “b”—c…", "", None]
    assert clean(marks=True)[0][0] == "A “b”—c…" and clean(smart=True)[0][0] == 'Á "b"-c...' and clean(space=False)[0][0] == text.replace("Á", "Á")
