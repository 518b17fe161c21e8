"""Facet queries: their encodings, the tests on paths, the typing of values, and the plan that answers them."""

from __future__ import annotations

import datetime as dt
import json
import re
from decimal import Decimal, InvalidOperation
from urllib.parse import parse_qsl, unquote

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from facetry.plans import compile as plan
from facetry.plans import shapes as s
from facetry.sources.catalog import Catalog, Reference


class Malformed(ValueError):
    """A query that isn't one."""


class UnknownStep(ValueError):
    """A path that the catalog doesn't have."""


#: What stands before a path, the longer first where one begins another: fixed values of the query language.
PREFIXES = {
    "^": "datatype", "@": "clazz", "%": "range",
    ">=": "min_inclusive", "<=": "max_inclusive", ">": "min_exclusive", "<": "max_exclusive",
    "$>": "min_length", "$<": "max_length", "*": "pattern", "~": "like", "'": "stem",
    "#>": "min_count", "#<": "max_count", "!": "all", "?": "any",
}
_LONGEST = sorted(PREFIXES, key=len, reverse=True)


def decoded(text: str) -> dict:
    """The query's JSON object, from JSON, URL-encoded JSON or form parameters; nothing asks for plain items."""
    text = text.strip()
    if text.lower().startswith("%7b"):
        text = unquote(text)
    if not text:
        return {}
    if text.startswith("{"):
        try:
            return json.loads(text)
        except json.JSONDecodeError as e:
            raise Malformed(str(e)) from e
    out: dict = {}
    for key, value in parse_qsl(text, keep_blank_values=True):
        if key in (".terms", ".stats"):
            out[key] = value
        elif key in (".offset", ".limit"):
            out[key] = counted(value, key)
        else:
            out.setdefault(key, []).extend(x for x in value.split(",") if x)
    return out


def counted(value, name: str) -> int:
    try:
        n = int(value)
    except (TypeError, ValueError) as e:
        raise Malformed(f"{name}: {value!r} isn't a number") from e
    if n < 0:
        raise Malformed(f"{name}: {n} is negative")
    return n


def steps_of(path: str) -> list[str]:
    if not path:
        return []
    if not re.fullmatch(r"\w+(\.\w+)*", path):
        raise Malformed(f"{path!r} isn't a path")
    return path.split(".")


def kind_of(catalog: Catalog, name: str, path: str) -> tuple[T.DataType, str]:
    """The data type at the end of a path, and the entity there if it is a reference (or the root), else ''."""
    entity, kind, at = catalog[name], None, name
    for label in steps_of(path):
        if not at:
            raise UnknownStep(f"{path}: values have no fields")
        try:
            steps = catalog.steps(entity.name, label)
        except KeyError:
            raise UnknownStep(f"{path}: {entity.name} has no {label}") from None
        for step in steps:
            found = entity.fields[step]
            if isinstance(found, Reference):
                entity, at = catalog[found.entity], found.entity
            else:
                kind, at = catalog.rows(entity.name).schema[found].dataType, ""
    return (kind, "") if not at else (catalog.rows(at).schema[catalog[at].key].dataType, at)


def typed(value, kind: T.DataType):
    """A value of the query as the data have it."""
    if value is None or isinstance(kind, T.StringType):
        return value if value is None else str(value)
    try:
        if isinstance(kind, T.IntegralType):
            return int(value)
        if isinstance(kind, (T.DoubleType, T.FloatType)):
            return float(value)
        if isinstance(kind, T.DecimalType):
            return Decimal(str(value))
        if isinstance(kind, T.DateType):
            return dt.date.fromisoformat(str(value))
        if isinstance(kind, (T.TimestampType, T.TimestampNTZType)):
            return dt.datetime.fromisoformat(str(value))
        if isinstance(kind, T.BooleanType):
            return {"true": True, "false": False}[str(value).lower()]
    except (ValueError, KeyError, InvalidOperation) as e:
        raise Malformed(f"{value!r} isn't of type {kind.simpleString()}") from e
    return value


#: Names of data types by Spark's.
KINDS = {"string": "string", "bigint": "integer", "int": "integer", "double": "double", "float": "double", "date": "date", "timestamp": "dateTime", "timestamp_ntz": "dateTime", "boolean": "boolean"}


def test_of(op: str, value, kind: T.DataType, is_entity: bool):
    one, many = (lambda: typed(s.listed(value)[0], kind)), (lambda: tuple(typed(v, kind) for v in s.listed(value)))
    size = lambda: counted(s.listed(value)[0], op)
    if op == "datatype":
        own = "reference" if is_entity else "decimal" if isinstance(kind, T.DecimalType) else KINDS.get(kind.simpleString(), kind.simpleString())
        fits = str(s.listed(value)[0]).split(":")[-1] in (own, "any")
        return s.Value("column_type", (fits, str(s.listed(value)[0])))
    if op == "clazz":
        return s.Clazz(str(s.listed(value)[0]))
    if op in ("range", "all", "any"):
        return {"range": s.in_range, "all": s.has_all, "any": s.has_any}[op](*many())
    if op in ("min_length", "max_length", "min_count", "max_count"):
        return getattr(s, op)(size())
    if op in ("pattern", "like", "stem"):
        return getattr(s, op)(str(s.listed(value)[0]))
    return getattr(s, op)(one())


def parsed(catalog: Catalog, name: str, query: str | dict) -> dict:
    """The query's shape and what it asks for. Keys that start with a dot, and empty values, are no tests; unknown steps and malformed values are errors."""
    found = decoded(query) if isinstance(query, str) else query
    tests: list = []
    for key, value in found.items():
        if key.startswith(".") or value in (None, "", []):
            continue
        prefix = next((p for p in _LONGEST if key.startswith(p)), "")
        path = key[len(prefix) :].strip()
        kind, at = kind_of(catalog, name, path)
        inner = test_of(PREFIXES.get(prefix, "any"), value, kind, bool(at))
        for step in reversed(steps_of(path)):
            inner = s.Field(step, inner)
        tests.append(inner)
    orders = [(o.strip().lstrip("+-"), o.strip().startswith("-")) for o in s.listed(found.get(".order") or [])]
    for path in [o for o, _ in orders] + [found[k] for k in (".terms", ".stats") if found.get(k)]:
        kind_of(catalog, name, path)
    return {"shape": s.both(*tests), "orders": orders, "offset": counted(found.get(".offset", 0), ".offset"), "limit": counted(found.get(".limit", 0), ".limit"), "terms": found.get(".terms"), "stats": found.get(".stats")}


def answered(catalog: Catalog, name: str, query: str | dict, project: dict[str, str] | None = None, base=True) -> DataFrame:
    """Terms if the query asks for them, else stats if it does, else items, all within the ``base`` shape."""
    q = parsed(catalog, name, query)
    shape = s.both(base, q["shape"])
    if q["terms"] is not None:
        return plan.labelled_terms(catalog, name, q["terms"], shape, q["offset"], q["limit"])
    if q["stats"] is not None:
        return plan.stats(catalog, name, q["stats"], shape)
    return plan.items_grouped(catalog, name, shape, project, q["orders"], q["offset"], q["limit"])


def document(catalog: Catalog, name: str, query: str | dict, project: dict[str, str] | None = None) -> DataFrame:
    """One row with the answer as JSON: items under ``contains`` in their order, ``terms``, or the stats. Terms are a page at most, as items are."""
    q = parsed(catalog, name, query)
    rows = answered(catalog, name, query, project)
    if q["terms"] is None and q["stats"] is not None:
        return rows.select(F.to_json(F.struct("count", "min", "max")).alias("json"))
    if q["terms"] is not None:
        rows = rows.orderBy(F.desc("count"), F.asc("value")).limit(min(q["limit"] or plan.PAGE, plan.PAGE))
        rows = rows.select(F.struct(-F.col("count"), "value").alias("at"), F.struct("value", "count").alias("x"))
        label = "terms"
    else:
        rows = rows.select(F.struct("position").alias("at"), F.struct(F.col("id").alias("@id"), *(project or {})).alias("x"))
        label = "contains"
    listed = F.transform(F.sort_array(F.collect_list(F.struct("at", "x"))), lambda y: y["x"])
    return rows.agg(F.to_json(F.struct(listed.alias(label))).alias("json"))
