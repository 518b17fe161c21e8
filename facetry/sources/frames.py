"""Linked JSON from statements (``s``, ``p``, ``o`` and, where there are any, ``lang``): a tree for each focus, as far as a shape goes, and back."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from facetry.plans import shapes as sh
from facetry.plans.shapes import Lang, Localized

ID = "@id"


def kinds_of(shape) -> tuple[bool, bool, bool]:
    """Whether a field's value has fields, is in languages, and is one at most."""
    texts = any(isinstance(s, (Lang, Localized)) for s in sh.parts(shape))
    return bool(sh.fields_of(shape)), texts, sh.sizes(shape)[1] == 1


def alone(shape) -> bool:
    return any(isinstance(s, Localized) for s in sh.parts(shape))


def schema_of(shape, name: str = ID) -> T.StructType:
    """The objects' type: one value plainly, several as an array, texts by language, one a language plainly."""
    out, text = [T.StructField(name, T.StringType())], T.StringType()
    for label, inner in sh.fields_of(shape).items():
        nested, texts, one = kinds_of(inner)
        kind = schema_of(inner, name) if nested else T.MapType(text, text if alone(inner) else T.ArrayType(text)) if texts else text
        out.append(T.StructField(label, kind if one or texts else T.ArrayType(kind)))
    return T.StructType(out)


def stepped(rows: DataFrame, store: DataFrame, predicate: str) -> DataFrame:
    """``path``, ``o``, ``lang``: what a predicate, backward if ``^`` stands before it, leads to from the end of each path."""
    back, name = predicate.startswith("^"), predicate.lstrip("^")
    edges = store.where(F.col("p") == name)
    edges = edges.select(F.col("o").alias("_from"), F.col("s").alias("o"), F.lit(None).cast("string").alias("lang")) if back else edges.select(F.col("s").alias("_from"), "o", "lang")
    return rows.join(edges.dropna(subset=["_from", "o"]).distinct(), F.col("node") == F.col("_from")).select("path", "o", "lang")


def objects(rows: DataFrame, store: DataFrame, shape, context: dict[str, str], name: str) -> DataFrame:
    """``path`` and its end's object. A name that the path holds already is told without fields, so that circles end."""
    out, columns = rows.select("path", "node"), [F.col("node").alias(name)]
    for k, (label, inner) in enumerate(sh.fields_of(shape).items()):
        nested, texts, one = kinds_of(inner)
        found = stepped(rows, store, context.get(label, label))
        if nested:
            kind = schema_of(inner, name)
            met = F.array_contains("path", F.col("o"))
            below = found.where(~met).select("path", F.concat("path", F.array("o")).alias("_deeper"), "o")
            deeper = objects(below.select(F.col("_deeper").alias("path"), F.col("o").alias("node")).distinct(), store, inner, context, name).select(F.col("path").alias("_deeper"), F.col("object").alias("value"))
            plain = F.struct(F.col("o").alias(name), *(F.lit(None).cast(f.dataType).alias(f.name) for f in kind.fields[1:])).alias("value")
            found = below.join(deeper, "_deeper").select("path", "o", "value").union(found.where(met).select("path", "o", plain))
        else:
            found = found.select("path", "o", F.col("lang") if texts else F.col("o").alias("value"))
        if texts:
            found = found.where("lang IS NOT NULL").groupBy("path", "lang").agg(F.sort_array(F.collect_set("o")).alias("texts"))
            value = F.get("texts", F.lit(0)) if alone(inner) else F.col("texts")
            values = F.map_from_entries(F.sort_array(F.collect_list(F.struct("lang", value.alias("value")))))
        else:
            values = F.transform(F.sort_array(F.collect_list(F.struct("o", "value"))), lambda x: x["value"]) if not nested else F.transform(F.array_sort(F.collect_list(F.struct("o", "value")), lambda a, b: F.when(a["o"] < b["o"], -1).when(a["o"] > b["o"], 1).otherwise(0)), lambda x: x["value"])
        column = f"_{k}"
        out = out.join(found.groupBy("path").agg((F.get(values, F.lit(0)) if one and not texts else values).alias(column)), "path", "left")
        columns.append(F.col(column).alias(label))
    return out.select("path", F.struct(*columns).alias("object"))


def framed(store: DataFrame, foci: DataFrame, shape, context: dict[str, str] | None = None, name: str = ID) -> DataFrame:
    """``focus`` and ``json``, the tree of what the shape knows of each focus (a name). ``context`` gives the predicates of labels, ``^`` before those that are walked backward; ``name`` is what names are told under.

    Each field is one join. Of several values where one is allowed the least is told; missing ones are left out, null foci
    dropped.
    """
    store = store if "lang" in store.columns else store.withColumn("lang", F.lit(None).cast("string"))
    rows = foci.select(F.col(foci.columns[0]).alias("node")).dropna().distinct().withColumn("path", F.array("node"))
    found = objects(rows, store, shape, context or {}, name)
    return found.select(F.get("path", F.lit(0)).alias("focus"), F.to_json("object").alias("json"))


def unframed(frames: DataFrame, shape, context: dict[str, str] | None = None, name: str = ID, json: str = "json") -> DataFrame:
    """The statements (``s``, ``p``, ``o``, ``lang``) that frames state, each once; text that is no such object states nothing."""
    value = frames.select(F.from_json(json, schema_of(shape, name)).alias("v"))
    return reduce(DataFrame.union, stated(value, shape, context or {}, name)).where("s IS NOT NULL AND o IS NOT NULL").distinct()


def stated(value: DataFrame, shape, context: dict[str, str], name: str) -> list[DataFrame]:
    out = []
    for label, inner in sh.fields_of(shape).items():
        nested, texts, one = kinds_of(inner)
        predicate, at = context.get(label, label), F.col(f"v.`{label}`")
        back, predicate = predicate.startswith("^"), predicate.lstrip("^")
        subject, no_lang = F.col(f"v.`{name}`").alias("s"), F.lit(None).cast("string").alias("lang")
        if texts:
            entries = value.select(subject, F.explode(at).alias("lang", "o"))
            entries = entries if alone(inner) else entries.select("s", "lang", F.explode("o").alias("o"))
            out.append(entries.select("s", F.lit(predicate).alias("p"), "o", "lang"))
            continue
        reached = value.select(subject, F.explode(F.array(at) if one else at).alias("v"))
        o: Column = F.col(f"v.`{name}`") if nested else F.col("v")
        a, b = (o, F.col("s")) if back else (F.col("s"), o)
        out.append(reached.select(a.alias("s"), F.lit(predicate).alias("p"), b.alias("o"), no_lang))
        if nested:
            out += stated(reached.select("v"), inner, context, name)
    return out or [value.select(*(F.lit(None).cast("string").alias(c) for c in ("s", "p", "o", "lang"))).limit(0)]
