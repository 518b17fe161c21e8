"""Statements that follow from a schema among the statements: classes and properties below others, domains and ranges."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from facetry.operators.durable import durable
from facetry.operators.flow import Grown
from facetry.operators.graph import closure

TYPE, SUBCLASS, SUBPROPERTY, DOMAIN, RANGE = "rdf:type", "rdfs:subClassOf", "rdfs:subPropertyOf", "rdfs:domain", "rdfs:range"
TRIPLE = ["s", "p", "o"]


def inferred(store: DataFrame, resource: Column | None = None) -> DataFrame:
    """``s``, ``p``, ``o`` of the statements and all that follow from them, each once, whatever their graphs.

    Classes and properties are closed by doubling; then rounds apply the rules to what the last round found, against the closed schema,
    until nothing is new. Where a round finds statements of the schema, the schema is closed again and all statements are fresh.
    ``resource`` tells on ``o`` which objects are no literals and so can have a type from a range (by default all).
    """
    found = Grown(store.select(TRIPLE).dropna())
    while True:
        above, schema = closed(found.all())
        new, fresh = found.grow(above), found.all()
        while found.grow(consequences(fresh, schema, resource)):
            new, fresh = True, found.fresh
            if not fresh.where(F.col("p").isin(SUBCLASS, SUBPROPERTY, DOMAIN, RANGE)).isEmpty():
                break
        else:
            return found.all()


def pairs(store: DataFrame, predicate: str, a: str, b: str) -> DataFrame:
    return store.where(F.col("p") == predicate).select(F.col("s").alias(a), F.col("o").alias(b)).distinct()


def closed(store: DataFrame) -> tuple[DataFrame, dict[str, DataFrame]]:
    """The closed pairs of classes and properties as statements, and the schema's tables."""
    above = {p: durable(closure(pairs(store, p, "a", "b"))) for p in (SUBCLASS, SUBPROPERTY)}
    schema = {p: above[p].where("a <> b").select(F.col("a").alias("_of"), F.col("b").alias("_is")) for p in above}
    schema |= {p: durable(pairs(store, p, "_of", "_is")) for p in (DOMAIN, RANGE)}
    told = (rows.select(F.col("a").alias("s"), F.lit(p).alias("p"), F.col("b").alias("o")) for p, rows in above.items())
    return reduce(DataFrame.union, told), schema


def consequences(fresh: DataFrame, schema: dict[str, DataFrame], resource: Column | None) -> DataFrame:
    """What one step of each rule gives from fresh statements. The schema's side of each join is the small one; a predicate of very many statements meets one row of it each."""
    by = lambda column, of, rows: rows.join(schema[of], F.col(column) == F.col("_of"))
    typed = lambda rows, subject: rows.select(F.col(subject).alias("s"), F.lit(TYPE).alias("p"), F.col("_is").alias("o"))
    objects = fresh if resource is None else fresh.where(resource)
    return reduce(DataFrame.union, (
        by("p", SUBPROPERTY, fresh).select("s", F.col("_is").alias("p"), "o"),
        typed(by("p", DOMAIN, fresh), "s"),
        typed(by("p", RANGE, objects), "o"),
        typed(by("o", SUBCLASS, fresh.where(F.col("p") == TYPE)), "s"),
    ))
