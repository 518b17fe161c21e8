"""Typed tables as a graph: entities with their key, plain fields, references and inverse references."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Reference:
    """A step to another entity: forward along the own ``column``, or inverse along the other entity's ``column``."""

    entity: str
    column: str
    inverse: bool = False


@dataclass(frozen=True)
class Entity:
    name: str
    table: str
    key: str
    fields: dict[str, str | Reference] = field(default_factory=dict)
    #: SQL of a key that the table doesn't hold.
    key_sql: str | None = None
    #: The column that names an item's class.
    kind: str | None = None
    #: The step from an alias to its principal, whose fields an alias has, too.
    link: str | None = None
    #: The column with the language of a text field.
    langs: dict[str, str] = field(default_factory=dict)
    #: The items are the distinct values of the key, not the table's rows.
    distinct: bool = False


class Catalog:
    def __init__(self, spark: SparkSession, folder: str, entities: list[Entity], classes: list[tuple[str, str]] | None = None):
        """``classes`` are pairs of a class and one above it."""
        self.spark, self.folder, self.entities, self.classes = spark, folder, {e.name: e for e in entities}, classes or []

    def __getitem__(self, name: str) -> Entity:
        return self.entities[name]

    def rows(self, name: str) -> DataFrame:
        entity = self[name]
        rows = self.spark.read.parquet(f"{self.folder}/{entity.table}.parquet")
        if entity.distinct:
            return rows.select(entity.key).dropna().distinct()
        return rows.withColumn(entity.key, F.expr(entity.key_sql)) if entity.key_sql else rows

    def steps(self, name: str, label: str) -> list[str]:
        """A field's name after the steps to the principal that has it; none but the name for an entity's own field."""
        out, at, seen = [], self[name], set()
        while label not in at.fields and at.link and at.name not in seen:
            seen.add(at.name)
            out.append(at.link)
            at = self[at.fields[at.link].entity]
        if label not in at.fields:
            raise KeyError(f"{name} has no {label}")
        return [*out, label]

    def along(self, name: str, path: str) -> list[str]:
        """The steps of a dotted path, those to principals included."""
        out: list[str] = []
        for label in [p for p in path.split(".") if p]:
            for step in self.steps(name, label):
                found = self[name].fields[step]
                out.append(step)
                name = found.entity if isinstance(found, Reference) else ""
            if not name and label != path.split(".")[-1]:
                raise KeyError(f"{label} has no fields")
        return out


def trade(spark: SparkSession, folder: str) -> Catalog:
    """The star schema of customers, orders and parts."""
    e, r = Entity, Reference
    return Catalog(spark, folder, [
        e("region", "region", "r_regionkey", {"label": "r_name", "nations": r("nation", "n_regionkey", True)}),
        e("nation", "nation", "n_nationkey", {"label": "n_name", "region": r("region", "n_regionkey"), "customers": r("customer", "c_nationkey", True), "suppliers": r("supplier", "s_nationkey", True)}),
        e("customer", "customer", "c_custkey", {"name": "c_name", "segment": "c_mktsegment", "balance": "c_acctbal", "nation": r("nation", "c_nationkey"), "orders": r("order", "o_custkey", True)}, kind="c_mktsegment"),
        e("supplier", "supplier", "s_suppkey", {"name": "s_name", "balance": "s_acctbal", "nation": r("nation", "s_nationkey")}),
        e("order", "orders", "o_orderkey", {"status": "o_orderstatus", "total": "o_totalprice", "date": "o_orderdate", "customer": r("customer", "o_custkey"), "lines": r("line", "l_orderkey", True)}),
        e("line", "lineitem", "l_linekey", {"quantity": "l_quantity", "price": "l_extendedprice", "discount": "l_discount", "flag": "l_returnflag", "status": "l_linestatus", "shipped": "l_shipdate", "order": r("order", "l_orderkey"), "supplier": r("supplier", "l_suppkey")}, "l_orderkey * 10 + l_linenumber"),
        e("purchase", "orders", "o_orderkey", {"status": "o_orderstatus", "buyer": r("customer", "o_custkey")}, link="buyer"),
        e("document", "documents", "doc_id", {"text": "text", "source": "source", "size": "n_chars"}, langs={"text": "lang"}),
        e("size", "documents", "n_chars", {"texts": r("document", "n_chars", True)}, distinct=True),
    ], [("MACHINERY", "INDUSTRY"), ("AUTOMOBILE", "INDUSTRY"), ("BUILDING", "CONSTRUCTION"), ("INDUSTRY", "BUSINESS"), ("CONSTRUCTION", "BUSINESS")])
