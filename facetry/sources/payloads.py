"""Incoming JSON objects: checked against a shape, nested ones included, and cut to what the shape knows, in one pass over the rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from facetry.plans import shapes as sh
from facetry.plans.compile import below, conjunction, is_name, joined_by, rooted, rule_of
from facetry.plans.shapes import And, Clazz, Field, Lang, Localized, Or, Value, Values, When
from facetry.sources.catalog import Catalog, Reference

REPORT = "array<struct<path:string,rule:string>>"


def checked(rows: DataFrame, catalog: Catalog, name: str, shape, json: str = "json") -> DataFrame:
    """Adds ``report``, the tests that an object fails as (path, rule), and ``trimmed``, the object with the fields that the shape knows, null if anything fails.

    A field may hold one value or an array; null and missing are no value. Values that aren't of the table's type fail, and so
    does text that is no JSON object. Texts in languages are objects from language to text or texts. Fields that the shape
    doesn't know are left out, not reported. One value a field at most is told plainly, others as an array.
    """
    shape = rooted(catalog, name, shape)
    x = F.col("_parsed")
    whole = x.isNotNull() & F.json_object_keys(json).isNotNull()
    report = F.when(whole, report_of(catalog, name, shape, F.array(x))).otherwise(failed("", "json"))
    with_report = once(once(rows, "_parsed", F.try_parse_json(json)), "report", report)
    return with_report.withColumn("trimmed", F.when(F.size("report") == 0, F.to_json(trimmed(catalog, name, shape, x)))).drop("_parsed")


def once(rows: DataFrame, name: str, column: Column) -> DataFrame:
    """Adds (or replaces) a column that is computed once a row: what uses it, filters included, doesn't repeat its expression."""
    return rows.select(*(F.col(f"`{c}`") for c in rows.columns if c != name), F.explode(F.array(column)).alias(name))


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """What ``use`` makes of a value, which is computed once, however often it stands in it."""
    return F.get(F.transform(F.array(value), use), 0)


def failed(path: str, rule: str) -> Column:
    return F.array(F.struct(F.lit(path).alias("path"), F.lit(rule).alias("rule")))


def nothing() -> Column:
    return F.array().cast(REPORT)


def all_of(reports: list[Column]) -> Column:
    return F.concat(*reports) if len(reports) > 1 else reports[0] if reports else nothing()


def values_of(x: Column, label: str) -> Column:
    """The values of a field of an object, one or an array, as an array."""
    path = f"$['{label}']"
    found = F.coalesce(F.try_variant_get(x, path, "array<variant>"), F.array(F.try_variant_get(x, path, "variant")))
    return F.filter(found, lambda v: v.isNotNull() & ~F.is_variant_null(v))


def texts_of(x: Column, label: str) -> Column:
    """The texts of an object from language to text or texts, as (value, lang)."""
    by_lang = F.map_entries(F.coalesce(F.try_variant_get(x, f"$['{label}']", "map<string,variant>"), F.create_map().cast("map<string,variant>")))
    each = lambda e: F.transform(F.coalesce(F.try_variant_get(e["value"], "$", "array<string>"), F.array(F.try_variant_get(e["value"], "$", "string"))), lambda v: F.struct(v.alias("value"), e["key"].alias("lang")))
    return F.filter(F.flatten(F.transform(by_lang, each)), lambda v: v["value"].isNotNull())


def in_languages(shape) -> bool:
    return any(isinstance(s, (Lang, Localized)) for s in sh.parts(shape))


def report_of(catalog: Catalog, name: str, shape, group: Column) -> Column:
    """What fails of a shape for a group of objects of an entity."""
    if isinstance(shape, And):
        return all_of([report_of(catalog, name, s, group) for s in shape.shapes])
    if isinstance(shape, Or):
        return F.when(passed(catalog, name, shape, group), nothing()).otherwise(failed("", "or"))
    if isinstance(shape, When):
        return F.when(passed(catalog, name, shape.test, group), report_of(catalog, name, shape.then, group)).otherwise(report_of(catalog, name, shape.other, group))
    if isinstance(shape, Field):
        return F.flatten(F.transform(group, lambda x: report_of_field(catalog, name, shape, x)))
    if isinstance(shape, bool):
        return nothing() if shape else failed("", "none")
    if isinstance(shape, Clazz):
        return F.when(passed(catalog, name, shape, group), nothing()).otherwise(failed("", shape.rule))
    return nothing() if is_name(shape) else of_values(shape, names_of(group), F.size(group))


def names_of(group: Column) -> Column:
    return F.filter(F.transform(group, lambda x: F.coalesce(F.try_variant_get(x, "$['@id']", "string"), F.try_variant_get(x, "$", "string"))), lambda v: v.isNotNull())


def passed(catalog: Catalog, name: str, shape, group: Column) -> Column:
    """Whether ``report_of`` would tell nothing: no report is made, and what is settled early is looked at no further."""
    if isinstance(shape, (And, Or)):
        return joined_by([passed(catalog, name, s, group) for s in shape.shapes], shape)
    if isinstance(shape, When):
        return F.when(passed(catalog, name, shape.test, group), passed(catalog, name, shape.then, group)).otherwise(passed(catalog, name, shape.other, group))
    if isinstance(shape, Field):
        return F.forall(group, lambda x: passed_field(catalog, name, shape, x))
    if isinstance(shape, bool):
        return F.lit(shape)
    if isinstance(shape, Clazz):
        kind = catalog[name].kind
        label = next((k for k, v in catalog[name].fields.items() if v == kind), kind)
        fits = lambda x: F.exists(values_of(x, label), lambda v: F.try_variant_get(v, "$", "string").isin(*below(catalog.classes, shape.name)))
        return F.coalesce(F.forall(group, fits), F.lit(False))
    return F.lit(True) if is_name(shape) else valid_values(shape, names_of(group), F.size(group))


def passed_field(catalog: Catalog, name: str, shape: Field, x: Column) -> Column:
    step = catalog[name].fields[shape.name]
    if isinstance(step, Reference):
        return bound(values_of(x, shape.name), lambda group: passed(catalog, step.entity, shape.shape, group))
    if in_languages(shape.shape):
        return bound(texts_of(x, shape.name), lambda group: F.size(of_texts(shape.shape, group)) == 0)
    kind = catalog.rows(name).schema[step].dataType.simpleString()
    return bound(F.transform(values_of(x, shape.name), lambda v: typed_value(v, kind)), lambda typed: F.forall(typed, lambda v: v.isNotNull()) & valid_values(shape.shape, typed, F.size(typed)))


def report_of_field(catalog: Catalog, name: str, shape: Field, x: Column) -> Column:
    step = catalog[name].fields[shape.name]
    if isinstance(step, Reference):
        found = bound(values_of(x, shape.name), lambda group: report_of(catalog, step.entity, shape.shape, group))
    elif in_languages(shape.shape):
        found = bound(texts_of(x, shape.name), lambda group: of_texts(shape.shape, group))
    else:
        kind = catalog.rows(name).schema[step].dataType.simpleString()
        wrong = lambda typed: F.when(F.exists(typed, lambda v: v.isNull()), failed("", f"type({kind})")).otherwise(nothing())
        right = lambda typed: bound(F.filter(typed, lambda v: v.isNotNull()), lambda group: report_of_values(shape.shape, group, F.size(typed)))
        found = bound(F.transform(values_of(x, shape.name), lambda v: typed_value(v, kind)), lambda typed: F.concat(wrong(typed), right(typed)))
    path = lambda p: F.when(p == "", F.lit(shape.name)).otherwise(F.concat(F.lit(f"{shape.name}."), p))
    return F.transform(found, lambda r: F.struct(path(r["path"]).alias("path"), r["rule"].alias("rule")))


def typed_value(v: Column, kind: str) -> Column:
    """A JSON value as a table's type has it; null if it isn't of that type. Dates and times are texts in JSON."""
    if kind in ("date", "timestamp", "timestamp_ntz"):
        return F.try_variant_get(v, "$", "string").try_cast(kind)
    if kind == "string":
        return F.when(F.schema_of_variant(v) == "STRING", F.try_variant_get(v, "$", "string"))
    return F.when(F.schema_of_variant(v) != "STRING", F.try_variant_get(v, "$", kind))


def report_of_values(shape, group: Column, size: Column) -> Column:
    """What fails of a shape without steps for a group of plain values."""
    if isinstance(shape, And):
        return all_of([report_of_values(s, group, size) for s in shape.shapes])
    if isinstance(shape, Or):
        return F.when(valid_values(shape, group, size), nothing()).otherwise(failed("", "or"))
    if isinstance(shape, When):
        return F.when(valid_values(shape.test, group, size), report_of_values(shape.then, group, size)).otherwise(report_of_values(shape.other, group, size))
    if isinstance(shape, bool):
        return nothing() if shape else failed("", "none")
    return of_values(shape, group, size)


def of_values(shape, group: Column, size: Column) -> Column:
    return F.when(valid_values(shape, group, size), nothing()).otherwise(failed("", rule_of(shape)))


def valid_values(shape, group: Column, size: Column) -> Column:
    """Whether a group of plain values passes a shape without steps."""
    if isinstance(shape, (And, Or)):
        return joined_by([valid_values(s, group, size) for s in shape.shapes], shape)
    if isinstance(shape, When):
        return F.when(valid_values(shape.test, group, size), valid_values(shape.then, group, size)).otherwise(valid_values(shape.other, group, size))
    if isinstance(shape, bool):
        return F.lit(shape)
    ok = F.lit(True)
    if isinstance(shape, Value):
        ok = F.forall(group, lambda v: F.coalesce(shape.test(v, True), F.lit(True)))
    elif isinstance(shape, Values):
        if shape.least is not None:
            ok = ok & (size >= shape.least)
        if shape.most is not None:
            ok = ok & (size <= shape.most)
        for v in shape.all:
            ok = ok & F.array_contains(group, v)
        if shape.any:
            ok = ok & F.exists(group, lambda v: v.isin(*shape.any))
        if shape.every:
            ok = ok & F.forall(group, lambda v: F.coalesce(shape.every.test(v, True), F.lit(True)))
    else:
        return F.lit(False)  # plain values have no fields
    return F.coalesce(ok, F.lit(False))


def of_texts(shape, group: Column) -> Column:
    """What fails of a shape for texts (value, lang)."""
    out, plain = [], []
    for s in conjunction(shape):
        if isinstance(s, Lang):
            ok = F.forall(group, lambda v: v["lang"].isin(*s.tags) if s.tags else v["lang"] != "")  # noqa: B023
        elif isinstance(s, Localized):
            ok = F.size(group) == F.size(F.array_distinct(F.transform(group, lambda v: v["lang"])))
        else:
            plain.append(s)
            continue
        out.append(F.when(ok, nothing()).otherwise(failed("", s.rule)))
    texts = F.transform(group, lambda v: v["value"])
    return all_of([*out, *(report_of_values(s, texts, F.size(texts)) for s in plain)])


def trimmed(catalog: Catalog, name: str, shape, x: Column) -> Column:
    """The object as a struct of its name and the fields that the shape knows; references without fields are told by their names."""
    entity, fields = catalog[name], sh.fields_of(shape)
    parts = [F.try_variant_get(x, "$['@id']", "string").alias("@id")]
    for label, inner in fields.items():
        step, one = entity.fields[label], sh.sizes(inner)[1] == 1
        if isinstance(step, Reference):
            if sh.fields_of(inner):
                values = F.transform(values_of(x, label), lambda v: trimmed(catalog, step.entity, inner, v))  # noqa: B023
            else:
                values = F.transform(values_of(x, label), lambda v: F.coalesce(F.try_variant_get(v, "$['@id']", "string"), F.try_variant_get(v, "$", "string")))
        elif in_languages(inner):
            alone = any(isinstance(s, Localized) for s in sh.parts(inner))
            by = F.map_from_entries(F.transform(F.array_distinct(F.transform(texts_of(x, label), lambda v: v["lang"])), lambda k: F.struct(k, F.transform(F.filter(texts_of(x, label), lambda v: v["lang"] == k), lambda v: v["value"]))))  # noqa: B023
            plain = F.when(F.size(by) > 0, F.transform_values(by, lambda _, v: F.get(v, 0)) if alone else by)
            parts.append(plain.alias(label))
            continue
        else:
            kind = catalog.rows(name).schema[step].dataType.simpleString()
            values = F.transform(values_of(x, label), lambda v: typed_value(v, kind))  # noqa: B023
        parts.append((F.get(values, 0) if one else bound(values, lambda v: F.when(F.size(v) > 0, v))).alias(label))
    return F.struct(*parts)
