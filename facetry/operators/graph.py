"""Statements as rows (graph, s, p, o): from tables, set-wise changes, closure."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from facetry.operators.durable import durable

STATEMENT = ["graph", "s", "p", "o"]


def statements(rows: DataFrame, graph: str, prefix: str, key: str) -> DataFrame:
    """A statement for each value that isn't null, with the key's name as subject."""
    others = [c for c in rows.columns if c != key]
    pairs = F.explode(F.array(*(F.struct(F.lit(c).alias("p"), F.col(c).cast("string").alias("o")) for c in others)))
    return rows.select(F.lit(graph).alias("graph"), F.concat(F.lit(prefix), F.col(key).cast("string")).alias("s"), pairs.alias("x")).select("graph", "s", "x.p", "x.o").where("o is not null")


def create(store: DataFrame, new: DataFrame) -> DataFrame:
    """Adds descriptions of subjects that the store doesn't know; statements are a set."""
    return store.unionByName(new.join(store.select("s").distinct(), "s", "left_anti").select(STATEMENT)).distinct()


def update(store: DataFrame, new: DataFrame, visible: list[str]) -> DataFrame:
    """Replaces the visible predicates of known subjects."""
    known = new.join(store.select("s").distinct(), "s", "left_semi").select(STATEMENT)
    stays = store.join(known.select("s").distinct().withColumn("_hit", F.lit(True)), "s", "left").where(F.col("_hit").isNull() | ~F.col("p").isin(*visible))
    return stays.select(STATEMENT).unionByName(known).distinct()


def delete(store: DataFrame, subjects: DataFrame, visible: list[str]) -> DataFrame:
    gone = subjects.select("s").distinct().withColumn("_hit", F.lit(True))
    return store.join(gone, "s", "left").where(F.col("_hit").isNull() | ~F.col("p").isin(*visible)).select(STATEMENT)


def replace_graph(store: DataFrame, graph: str, new: DataFrame) -> DataFrame:
    return store.where(~F.col("graph").eqNullSafe(F.lit(graph))).unionByName(new.withColumn("graph", F.lit(graph)).select(STATEMENT)).distinct()


def graphs(store: DataFrame) -> DataFrame:
    return store.select("graph").distinct()


def outcomes(store: DataFrame, subjects: DataFrame, known: str, unknown: str) -> DataFrame:
    """``s`` and ``outcome`` of each subject, once: whether the store describes it. Creating a known subject is a conflict; changing or deleting an unknown one finds nothing."""
    have = store.select("s").distinct().withColumn("_have", F.lit(True))
    found = subjects.select("s").dropna().distinct().join(have, "s", "left")
    return found.select("s", F.when(F.col("_have"), known).otherwise(unknown).alias("outcome"))


def graph_outcome(store: DataFrame, graph: str, known: str, unknown: str) -> DataFrame:
    """One row, ``graph`` and ``outcome``: whether the store has a statement in the graph."""
    hit = store.where(F.col("graph") == graph).limit(1).agg(F.count("*").alias("n"))
    return hit.select(F.lit(graph).alias("graph"), F.when(F.col("n") > 0, known).otherwise(unknown).alias("outcome"))


def drop_graph(store: DataFrame, graph: str) -> DataFrame:
    return store.where(~F.col("graph").eqNullSafe(F.lit(graph)))


def closure(edges: DataFrame) -> DataFrame:
    """All pairs (a, b) with a path of one or more edges, in rounds that double the paths: a chain of n edges takes log n rounds.

    A round finds the pairs whose shortest path has exactly twice as many edges as the last round's, and adds each of them followed
    by a known shorter path. So a pair is reached by one split of its length, not by all, and is found in the round of its length.
    """
    exact = durable(edges.select("a", "b").dropna().distinct())
    parts = [exact]
    while True:
        known = reduce(DataFrame.union, parts)
        exact = durable(unknown(exact, exact, known))
        if exact.isEmpty():
            return known
        parts += [exact, durable(unknown(exact, known, known.union(exact)))]


def unknown(first: DataFrame, then: DataFrame, known: DataFrame) -> DataFrame:
    """The pairs of ends of a pair of the first and one of the second that follows, but for known ones."""
    after = first.select("a", F.col("b").alias("_at")).join(then.select(F.col("a").alias("_at"), "b"), "_at").select("a", "b")
    return after.distinct().join(known, ["a", "b"], "left_anti")
