"""Linked JSON by a projection: which fields of an entity, and of those that it refers to, an item's object has."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from facetry.sources.catalog import Catalog, Reference


def encoded(catalog: Catalog, name: str, fields: dict, json: str = "json", items: DataFrame | None = None) -> DataFrame:
    """``id`` and the object of each item (of ``items``, if given) as JSON. ``fields`` gives a nested projection for each reference, None for a plain field; what an inverse reference reaches is an array in the order of keys."""
    rows, value = objects(catalog, name, fields, items)
    return rows.select(F.col(catalog[name].key).alias("id"), F.to_json(value).alias(json))


def objects(catalog: Catalog, name: str, fields: dict, items: DataFrame | None = None):
    """An entity's rows, joined to what they refer to, and the object as a column."""
    entity, rows, parts = catalog[name], catalog.rows(name) if items is None else items, []
    for label, inner in fields.items():
        step = entity.fields[label]
        if not isinstance(step, Reference):
            parts.append(F.col(step).alias(label))
            continue
        far, value = objects(catalog, step.entity, inner or {})
        if step.inverse:
            found = far.select(F.col(step.column).alias(f"_{label}_to"), F.struct(catalog[step.entity].key, value.alias("x")).alias("y"))
            found = found.groupBy(f"_{label}_to").agg(F.transform(F.sort_array(F.collect_list("y")), lambda y: y["x"]).alias(f"_{label}"))
            own = entity.key
        else:
            found = far.select(F.col(catalog[step.entity].key).alias(f"_{label}_to"), value.alias(f"_{label}"))
            own = step.column
        rows = rows.join(found, F.col(own) == F.col(f"_{label}_to"), "left")
        parts.append(F.col(f"_{label}").alias(label))
    return rows, F.struct(F.concat(F.lit(f"{name}/"), F.col(entity.key).cast("string")).alias("@id"), *parts)


def schema_of(catalog: Catalog, name: str, fields: dict) -> T.StructType:
    """The objects' type, from the tables' types."""
    entity, kinds = catalog[name], [T.StructField("@id", T.StringType())]
    for label, inner in fields.items():
        step = entity.fields[label]
        if isinstance(step, Reference):
            kind = schema_of(catalog, step.entity, inner or {})
            kinds.append(T.StructField(label, T.ArrayType(kind) if step.inverse else kind))
        else:
            kinds.append(T.StructField(label, catalog.rows(name).schema[step].dataType))
    return T.StructType(kinds)


def decoded(rows: DataFrame, catalog: Catalog, name: str, fields: dict, json: str = "json") -> DataFrame:
    """The statements (s, p, o) that the objects state, nested ones included, as a set; text that isn't such an object states nothing."""
    value = rows.select(F.from_json(json, schema_of(catalog, name, fields)).alias("v"))
    return stated(value, catalog, name, fields).where("s is not null and o is not null").distinct()


def named(label: str, values):
    return F.transform(values, lambda x: F.struct(F.lit(label).alias("p"), x.alias("o")))


def stated(value: DataFrame, catalog: Catalog, name: str, fields: dict) -> DataFrame:
    entity, own, deeper = catalog[name], [], []
    for label, inner in fields.items():
        step = entity.fields[label]
        if not isinstance(step, Reference):
            own.append(F.array(F.struct(F.lit(label).alias("p"), F.col(f"v.{label}").cast("string").alias("o"))))
            continue
        reached = F.col(f"v.{label}") if step.inverse else F.array(F.col(f"v.{label}"))
        own.append(named(label, F.coalesce(F.transform(reached, lambda x: x["@id"]), F.array().cast("array<string>"))))
        deeper.append(stated(value.select(F.explode(reached).alias("v")), catalog, step.entity, inner or {}))
    out = value.select(F.col("v.`@id`").alias("s"), F.explode(F.flatten(F.array(*own))).alias("x")).select("s", "x.p", "x.o")
    for more in deeper:
        out = out.union(more)
    return out
