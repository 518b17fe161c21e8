"""Shapes: their algebra, rewriting and validation, on small tables."""

import json

import pytest
from pyspark.sql import functions as F

from facetry.plans import compile as plan
from facetry.plans import facets
from facetry.plans import shapes as s
from facetry.sources import payloads
from facetry.sources.catalog import Catalog, Entity, Reference


@pytest.fixture(scope="module")
def shop(spark, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("shop"))
    people = [(1, "Ada", "a@x.y", 30, "2020-01-31", "Red", None), (2, "Bob", None, 17, "2020-02-30", "Blue", 1), (3, None, "abc", None, "abc", None, 2), (4, "Cy\nD", "c@x.y", 99, None, "Red", 9)]
    spark.createDataFrame(people, "pk long, name string, mail string, age int, born string, kind string, boss long").write.parquet(f"{folder}/people.parquet")
    spark.createDataFrame([(10, 1, "en", "one"), (11, 1, "en", "uno"), (12, 2, "it", "due"), (13, 2, "en", "two"), (14, 7, None, "x"), (15, 3, None, None)], "nk long, owner long, lang string, word string").write.parquet(f"{folder}/notes.parquet")
    spark.createDataFrame([(100, 1), (101, 3), (102, None), (103, 77)], "ak long, person long").write.parquet(f"{folder}/aliases.parquet")
    return Catalog(spark, folder, [
        Entity("person", "people", "pk", {"name": "name", "mail": "mail", "age": "age", "born": "born", "kind": "kind", "boss": Reference("person", "boss"), "notes": Reference("note", "owner", True)}, kind="kind"),
        Entity("note", "notes", "nk", {"word": "word", "owner": Reference("person", "owner")}, langs={"word": "lang"}),
        Entity("alias", "aliases", "ak", {"person": Reference("person", "person")}, link="person"),
    ], [("Red", "Warm"), ("Warm", "Colour"), ("Blue", "Colour")])


def ids(shop, name, shape):
    return sorted(r[0] for r in plan.selected(shop, name, shape).select(shop[name].key).collect())


def report(shop, name, shape):
    return sorted(map(tuple, plan.violations(shop, name, shape).collect()))


def test_conjunctions_and_alternatives_are_told_shortly():
    assert s.both(s.min_count(1), s.min_count(3), s.max_count(9), s.max_count(4)) == s.And((s.min_count(3), s.max_count(4)))
    assert s.both(s.in_range(1, 2, 3), s.in_range(3, 2)) == s.in_range(2, 3)
    assert s.either(s.in_range(1, 2), s.in_range(2, 3)) == s.in_range(1, 2, 3)
    assert s.both(s.has_all(1), s.has_all(2, 1)) == s.has_all(1, 2)
    assert s.both(s.lang("en", "it"), s.lang("it", "fr")) == s.lang("it") and s.either(s.lang("en"), s.lang("it")) == s.lang("en", "it") and s.either(s.lang("en"), s.lang()) == s.lang()
    assert s.both(s.lang(), s.lang("en")) == s.lang("en")
    assert s.both(s.datatype("any"), s.datatype("iri"), s.datatype("resource")) == s.datatype("iri")
    for wrong in (lambda: s.both(s.datatype("iri"), s.datatype("string")), lambda: s.both(s.lang("en"), s.lang("it")), lambda: s.datatype("colour"), lambda: s.expanded(s.both(s.datatype("string"), s.field("x", True)))):
        with pytest.raises(ValueError):
            wrong()
    assert s.both(s.field("x", s.min_count(1)), s.field("x", s.max_count(1))) == s.field("x", s.required()) and s.both(True, s.stem("a"), s.stem("a")) == s.stem("a")
    assert s.optional() == s.max_count(1) and s.repeatable() == s.min_count(1) and s.multiple() is True and s.link("p", False) is True


def test_what_follows_from_a_shape():
    string, resource = s.datatype("string"), s.datatype("resource")
    assert s.expanded(s.datatype("boolean")) == s.both(s.datatype("boolean"), s.in_range(False, True), s.max_count(1))
    assert s.expanded(s.Clazz("C")) == s.both(s.Clazz("C"), resource)
    assert s.expanded(s.in_range("a", "b")) == s.both(s.in_range("a", "b"), s.max_count(2), string)
    assert s.expanded(s.in_range("a", 1)) == s.both(s.in_range("a", 1), s.max_count(2))
    assert s.expanded(s.has_all("a", "b")) == s.both(s.has_all("a", "b"), s.min_count(2)) and s.expanded(s.has_any("a")) == s.both(s.has_any("a"), s.min_count(1))
    assert s.expanded(s.lang("en")) == s.both(s.lang("en"), s.datatype("langString"))
    assert set(s.expanded(s.both(s.localized(), s.lang("en", "it"))).shapes) == {s.localized(), s.lang("en", "it"), s.datatype("langString"), s.max_count(2)}
    assert s.expanded(s.field("x", s.stem("a"))) == s.both(s.field("x", s.stem("a")), resource)
    assert s.expanded(s.field("type", True)) == s.both(s.field("type", s.datatype("iri")), resource) and s.expanded(s.field("^x", True)) == s.field("^x", resource)
    assert s.expanded(s.link("p", s.stem("a"))) == s.both(s.link("p", s.stem("a"), resource), resource)
    assert s.expanded(s.either(s.Clazz("A"), s.Clazz("B"))) == s.either(s.both(s.Clazz("A"), resource), s.both(s.Clazz("B"), resource))
    once = s.expanded(s.both(s.field("x", s.in_range(True), s.datatype("boolean")), s.Clazz("C")))
    assert set(s.expanded(once).shapes) == set(once.shapes)


def test_languages_cut_to_those_asked_for():
    assert s.localised(s.lang("en"), "*", "it") == s.lang("en") and s.localised(s.lang("en", "it"), "en", "de") == s.lang("en")
    assert s.localised(s.lang("en", "it"), "fr", "de") == s.lang("fr", "de") and s.localised(s.lang("en", "it")) == s.lang("en", "it")
    assert s.localised(s.lang(), "fr") == s.lang("fr") and s.localised(s.lang()) == s.lang()
    assert s.localised(s.field("x", s.link("y", s.lang("en", "it"))), "it") == s.field("x", s.link("y", s.lang("it")))


def test_filtering_and_conveying():
    test, only = s.like("word"), lambda mode, x: s.When(s.Guard("mode", (mode,)), x, True)
    assert s.pruned(test, "filter") is True and s.pruned(s.field("x", test), "filter") is True
    assert s.pruned(only("filter", test), "filter") == test and s.pruned(s.field("x", only("filter", test)), "filter") == s.field("x", test)
    assert s.pruned(only("convey", test), "filter") is True and s.pruned(only("convey", s.field("x")), "filter") is True
    assert s.pruned(test, "convey") is True and s.pruned(s.field("x", test), "convey") == s.field("x")
    assert s.pruned(only("filter", test), "convey") is True and s.pruned(s.field("x", only("filter", test)), "convey") == s.field("x")
    assert s.pruned(only("convey", test), "convey") == test and s.pruned(s.Guard("role", ("a",)), "convey") == s.Guard("role", ("a",))


def test_outlines_and_names():
    me = s.Focus()
    assert s.outlined(s.Clazz("C"), me) == [(me, "type", "C")] and s.outlined(s.field("x", s.has_all(1, 2)), me) == [(me, "x", 1), (me, "x", 2)]
    assert s.outlined(s.field("^x", s.has_all("a")), me) == [("a", "x", me)] and s.outlined(s.has_any(1), me) == []
    assert s.outlined(s.both(s.has_all("a"), s.Clazz("C"))) == [("a", "type", "C")]
    assert s.outlined(s.link("p", s.Clazz("C")), me) == [(me, "type", "C")]
    assert s.resolved(s.field("x", s.has_any(s.Focus("/a"), "b"), s.min_inclusive(me)), "i/1") == s.field("x", s.has_any("i/1/a", "b"), s.min_inclusive("i/1"))


def test_inspectors():
    shape = s.both(s.Clazz("C"), s.datatype("iri"), s.min_count(1), s.max_count(3), s.in_range("a", "b"), s.lang("en"), s.min_length(2), s.min_length(5), s.link("p", s.field("x", s.stem("q"))), s.When(s.stem("z"), s.field("y", True), True))
    assert s.class_name(shape) == "C" and s.type_name(shape) == "iri" and s.sizes(shape) == (1, 3) and s.range_of(shape) == ("a", "b") and s.languages_of(shape) == ("en",)
    assert s.limits(shape)["min_length"] == 5 and set(s.fields_of(shape)) == {"x", "y"} and s.walked(shape, "x") == s.stem("q")
    assert s.class_name(True) is None and s.sizes(True) == (None, None) and s.range_of(True) is None
    with pytest.raises(KeyError):
        s.walked(shape, "x", "nope")


def test_selection(shop):
    assert ids(shop, "person", s.field("age", s.When(s.min_inclusive(18), s.max_exclusive(50), s.one_of(17)))) == [1, 2]
    assert ids(shop, "person", s.Clazz("Warm")) == [1, 4] and ids(shop, "person", s.either(s.Clazz("Blue"), s.field("age", s.min_inclusive(90)))) == [2, 4]
    assert ids(shop, "person", s.field("notes", s.field("word", s.localized()))) == [2, 3, 4]
    assert ids(shop, "person", s.field("notes", s.field("word", s.lang("it")))) == [2] and ids(shop, "note", s.field("word", s.lang())) == [10, 11, 12, 13]
    with pytest.raises(ValueError):
        ids(shop, "person", s.field("age", s.Guard("role", ("admin",))))


def test_aliases_have_their_principals_fields(shop):
    assert ids(shop, "alias", s.field("name", s.one_of("Ada"))) == [100] and ids(shop, "alias", s.field("boss", s.field("name", s.one_of("Bob")))) == [101]
    assert ids(shop, "alias", s.link("person", s.field("notes", s.min_count(2)))) == [100] and ids(shop, "note", s.field("owner", s.field("kind", s.one_of("Blue")))) == [12, 13]
    merged = plan.rooted(shop, "alias", s.both(s.field("name", s.stem("A")), s.field("age", s.min_inclusive(1)), s.link("person", s.field("mail", s.stem("a")))))
    assert isinstance(merged, s.Field) and merged.name == "person"  # one join
    found = plan.items(shop, "alias", project={"name": "name", "boss": "boss.name", "age": "age"}, orders=[("age", False)])
    assert [tuple(r) for r in found.collect()] == [(101, None, "Bob", None), (102, None, None, None), (103, None, None, None), (100, "Ada", None, 30)]
    assert facets.parsed(shop, "alias", {">= age": "20"})["shape"] == s.field("age", s.min_inclusive(20))
    with pytest.raises(facets.UnknownStep):
        facets.parsed(shop, "alias", {"colour": 1})


def test_validation(shop):
    assert report(shop, "person", s.field("mail", s.pattern("[a-z]@x"))) == [(1, "mail", "pattern([a-z]@x)"), (3, "mail", "pattern([a-z]@x)"), (4, "mail", "pattern([a-z]@x)")]
    assert report(shop, "person", s.field("mail", s.pattern("[a-z]@x.y"))) == [(3, "mail", "pattern([a-z]@x.y)")]
    assert report(shop, "person", s.field("born", s.datatype("date"))) == [(2, "born", "datatype(date)"), (3, "born", "datatype(date)")]
    assert report(shop, "person", s.field("name", s.required(s.datatype("string"), s.max_length(3)))) == [(3, "name", "1.. values"), (4, "name", "max_length(3)")]
    assert report(shop, "person", s.either(s.field("age", s.min_inclusive(18)), s.field("notes", s.min_count(2)))) == []
    assert report(shop, "person", s.either(s.field("age", s.min_inclusive(18)), s.field("notes", s.min_count(3)))) == [(2, "", "or")]
    assert report(shop, "person", s.When(s.field("notes", s.min_count(1)), s.field("age", s.required()), s.field("age", s.max_inclusive(9)))) == [(3, "age", "1.. values"), (4, "age", "max_inclusive(9)")]
    assert report(shop, "person", s.field("boss", s.field("boss", s.field("name", s.one_of("Zed"))))) == [(3, "boss.boss.name", "one_of(Zed)")]
    assert report(shop, "person", s.field("notes", s.field("word", s.lang("en")))) == [(2, "notes.word", "lang(en)")]
    assert report(shop, "person", s.field("notes", s.max_count(1), s.has_any(10, 13))) == [(1, "notes", "..1 values"), (2, "notes", "..1 values"), (3, "notes", "any(10, 13)"), (4, "notes", "any(10, 13)")]
    assert report(shop, "person", s.Clazz("Warm")) == [(2, "", "class(Warm)"), (3, "", "class(Warm)")]
    assert report(shop, "alias", s.field("age", s.min_inclusive(40))) == [(100, "person.age", "min_inclusive(40)")]
    assert report(shop, "person", True) == [] and len(report(shop, "person", False)) == 4


def test_data_types_of_texts(spark):
    texts = ["abc", "1", "-1", "1.5", ".5", "1e3", "true", "2020-02-29", "2021-02-29", "2020-01-01T10:00:00Z", "2020-01-01T25:00:00", "http://x", "_:b", "", None]
    rows = spark.createDataFrame([(t,) for t in texts], "t string")
    fits = {k: [r.t for r in rows.where(s.datatype(k).test(F.col("t"))).collect()] for k in ("integer", "decimal", "double", "boolean", "date", "dateTime", "iri", "resource", "string")}
    assert fits["integer"] == ["1", "-1"] and fits["decimal"] == ["1", "-1", "1.5", ".5"] and fits["double"] == ["1", "-1", "1.5", ".5", "1e3"] and fits["boolean"] == ["1", "true"]
    assert fits["date"] == ["2020-02-29"] and fits["dateTime"] == ["2020-01-01T10:00:00Z"] and fits["iri"] == ["http://x"] and fits["resource"] == ["http://x", "_:b"] and len(fits["string"]) == 14


def checked(spark, shop, name, shape, *objects):
    rows = spark.createDataFrame([(k, o if o is None or isinstance(o, str) else json.dumps(o)) for k, o in enumerate(objects)], "k long, json string")
    found = payloads.checked(rows.withColumn("report_", F.lit("extra")), shop, name, shape).orderBy("k").collect()
    return [sorted(map(tuple, r.report)) for r in found], [r.trimmed and json.loads(r.trimmed) for r in found]


def test_payloads(spark, shop):
    shape = s.both(s.field("name", s.required(s.pattern("[A-Z].*"))), s.field("age", s.optional(s.min_inclusive(18))), s.field("boss", s.optional(s.field("name", s.required()))), s.field("notes", s.field("word", s.multiple())))
    found, kept = checked(
        spark, shop, "person", shape,
        {"@id": "p/1", "name": "Ada", "age": 30, "boss": {"name": "Bob", "secret": 1}, "notes": [{"word": ["a", "b"]}, {"word": "c"}], "other": {"x": [1]}},
        {"name": ["ada", "B"], "age": 3, "boss": {"name": None}, "notes": {"word": 5}}, {"name": "A", "age": "old"}, "nothing", None, "[]", {"name": "Z", "age": None, "boss": []},
    )
    assert found == [[], [("age", "min_inclusive(18)"), ("boss.name", "1.. values"), ("name", "..1 values"), ("name", "pattern([A-Z].*)"), ("notes.word", "type(string)")], [("age", "type(int)")], [("", "json")], [("", "json")], [("", "json")], []]
    assert kept[0] == {"@id": "p/1", "name": "Ada", "age": 30, "boss": {"name": "Bob"}, "notes": [{"word": ["a", "b"]}, {"word": ["c"]}]} and kept[6] == {"name": "Z"} and kept[1:6] == [None] * 5


def test_payloads_with_alternatives_and_languages(spark, shop):
    shape = s.either(s.field("name", s.stem("A")), s.field("age", s.min_inclusive(50)))
    assert checked(spark, shop, "person", shape, {"name": "Ada"}, {"name": "Bob", "age": 60}, {"name": "Bob", "age": 6})[0] == [[], [], [("", "or")]]
    shape = s.When(s.field("kind", s.has_any("Red")), s.field("age", s.required()), s.field("mail", s.required()))
    assert checked(spark, shop, "person", shape, {"kind": "Red"}, {"kind": "Blue", "mail": "m"}, {"mail": []})[0] == [[("age", "1.. values")], [], [("mail", "1.. values")]]
    found, kept = checked(spark, shop, "note", s.field("word", s.lang("en", "it"), s.localized(), s.max_length(4)), {"word": {"en": "one", "it": "uno"}}, {"word": {"en": ["a", "b"], "fr": "cinque"}}, {})
    assert found == [[], [("word", "lang(en, it)"), ("word", "localized"), ("word", "max_length(4)")], []] and kept[0] == {"word": {"en": "one", "it": "uno"}} and kept[2] == {}
    assert checked(spark, shop, "person", s.Clazz("Warm"), {"kind": "Red"}, {"kind": "Blue"}, {})[0] == [[], [("", "class(Warm)")], [("", "class(Warm)")]]
    assert checked(spark, shop, "person", s.field("boss", s.has_any("p/1")), {"boss": "p/1"}, {"boss": {"@id": "p/2"}})[0] == [[], [("boss", "any(p/1)")]]


def test_payloads_are_parsed_once(spark, shop):
    rows = spark.createDataFrame([(1, "{}")], "k long, json string")
    shape = s.both(s.either(s.field("name", s.stem("A")), s.field("age", s.min_inclusive(50))), s.field("mail", s.required()))
    found = payloads.checked(rows, shop, "person", shape).where("trimmed IS NOT NULL").select("k", "trimmed")
    assert found._jdf.queryExecution().optimizedPlan().toString().lower().count("parse_json") + found._jdf.queryExecution().optimizedPlan().toString().count("parseJson") == 1


def test_payload_alternatives_over_many_values(spark, shop):
    shape = s.field("notes", s.min_count(1), s.either(s.field("word", s.has_any("a")), s.field("word", s.required(s.max_length(2)))))
    found = checked(spark, shop, "person", shape, {"notes": [{"word": "a"}, {"word": ["a", "long"]}]}, {"notes": [{"word": "bb"}, {"word": "cc"}]}, {"notes": [{"word": "long"}, {"word": "a"}]}, {"notes": [{"word": 5}]}, {})[0]
    assert found == [[], [], [("notes", "or")], [("notes", "or")], [("notes", "1.. values")]]


def test_conditions_along_references_are_joined_by_the_reference(spark, shop):
    warm = s.field("boss", s.field("kind", s.one_of("Red")))  # missing and unknown bosses fail no test
    adult, mail = s.field("age", s.min_inclusive(40)), s.field("mail", s.required())
    assert report(shop, "person", s.When(warm, adult, mail)) == [(1, "age", "min_inclusive(40)"), (2, "age", "min_inclusive(40)")]
    assert report(shop, "person", s.When(s.field("boss", s.field("kind", s.one_of("Blue"))), mail, adult)) == [(2, "age", "min_inclusive(40)")]
    assert report(shop, "person", s.When(s.either(warm, s.field("name", s.stem("Z"))), s.field("boss", s.field("age", s.max_exclusive(20))), mail)) == [(2, "boss.age", "max_exclusive(20)")]
    text = plan.violations(shop, "person", s.When(warm, adult, mail))._jdf.queryExecution().optimizedPlan().toString()
    assert "LeftAnti" not in text and "LeftSemi" not in text
