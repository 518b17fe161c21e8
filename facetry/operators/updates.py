"""Changes to a set of statements (graph, s, p, o), each as one plan over all of them, and mirrors of a changing source."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from facetry.operators.flow import looped
from facetry.operators.graph import STATEMENT
from facetry.operators.patterns import constructed

#: Predicates whose plain texts are in some language: fixed values.
LABELS = ("rdfs:label", "rdfs:comment", "schema:name", "schema:description", "dct:title", "dct:description")


def modified(store: DataFrame, graph: str, bindings: DataFrame, delete: tuple = (), insert: tuple = ()) -> DataFrame:
    """The statements of the store after those that the ``delete`` templates give are taken from the graph and those of ``insert`` are added to it."""
    out = store
    if delete:
        gone = constructed(bindings, *delete).withColumn("graph", F.lit(graph))
        out = out.join(gone, STATEMENT, "left_anti")
    if insert:
        out = out.select(STATEMENT).unionByName(constructed(bindings, *insert).withColumn("graph", F.lit(graph)).select(STATEMENT))
    return out.select(STATEMENT).distinct()


def uploaded(store: DataFrame, new: DataFrame, graph: str, clear: bool = False) -> DataFrame:
    """The store with the new statements in a graph, which ``clear`` empties first."""
    kept = store.where(~F.col("graph").eqNullSafe(F.lit(graph))) if clear else store
    return kept.select(STATEMENT).unionByName(new.withColumn("graph", F.lit(graph)).select(STATEMENT)).distinct()


def stale(items: DataFrame, current: DataFrame) -> DataFrame:
    """Of the (item, version) pairs of a source those that the mirror lacks or has in an older version only."""
    newest = current.groupBy(F.col("item").alias("_item")).agg(F.max("version").alias("_version"))
    return items.join(newest, (F.col("item") == F.col("_item")) & (F.col("_version") >= F.col("version")), "left_anti")


def mirrored(store: DataFrame, items: DataFrame, new: DataFrame) -> DataFrame:
    """The store with the items' descriptions replaced by the new statements about them."""
    wanted = items.select(F.col("item").alias("s")).distinct()
    return store.join(wanted, "s", "left_anti").select(STATEMENT).unionByName(new.join(wanted, "s", "left_semi").select(STATEMENT)).distinct()


def reaped(store: DataFrame, live: DataFrame, prefix: str) -> DataFrame:
    """The store without statements about, or to, items (names that begin with the prefix) that aren't alive."""
    names = live.select(F.col("item").alias("_item")).distinct()
    for column in ("s", "o"):
        dead = store.where(F.col(column).startswith(prefix)).select(F.col(column).alias("_dead")).distinct().join(names, F.col("_dead") == F.col("_item"), "left_anti")
        store = store.join(dead, F.col(column) == F.col("_dead"), "left_anti")
    return store


def refocused(store: DataFrame, old: str, new: str) -> DataFrame:
    """The statements with one name in the place of another, wherever it stands."""
    return store.select("graph", *(F.when(F.col(c) == old, F.lit(new)).otherwise(F.col(c)).alias(c) for c in "spo")).distinct()


def localised(store: DataFrame, lang: str, predicates: tuple[str, ...] = LABELS) -> DataFrame:
    """Adds ``lang``: that of plain texts of label-like predicates, else null."""
    return store.withColumn("lang", F.when(F.col("p").isin(*predicates), F.lit(lang)))


def crawled(links: DataFrame, seeds: DataFrame, prefix: str, most: int | None = None) -> DataFrame:
    """The pages reached from the seeds over ``links`` (source, target), round by round, within the prefix; fragments and queries of targets are left out."""
    clean = F.regexp_replace("target", "[?#].*$", "")
    steps = links.select(F.regexp_replace("source", "[?#].*$", "").alias("_from"), clean.alias("_to")).where(F.col("_to").startswith(prefix)).distinct()
    start = seeds.select(F.regexp_replace("url", "[?#].*$", "").alias("url")).where(F.col("url").startswith(prefix)).distinct()
    return looped(start, lambda fresh: fresh.join(steps, F.col("url") == F.col("_from")).select(F.col("_to").alias("url")).distinct(), most)
