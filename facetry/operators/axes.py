"""Steps over numbered nodes of trees (``page``, ``node``, ``last``, ``parent``, ``tag``, ``attributes``, ``text``), each one join."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: What holds between a node (a) and those that an axis leads to (b): numbers are given in the order of starts.
AXES = {
    "self": lambda a, b: a("node") == b("node"),
    "child": lambda a, b: a("node") == b("parent"),
    "parent": lambda a, b: a("parent") == b("node"),
    "descendant": lambda a, b: (b("node") > a("node")) & (b("node") <= a("last")),
    "descendant-or-self": lambda a, b: (b("node") >= a("node")) & (b("node") <= a("last")),
    "ancestor": lambda a, b: (b("node") < a("node")) & (b("last") >= a("last")),
    "ancestor-or-self": lambda a, b: (b("node") <= a("node")) & (b("last") >= a("last")),
    "following": lambda a, b: b("node") > a("last"),
    "preceding": lambda a, b: b("last") < a("node"),
    "following-sibling": lambda a, b: (b("parent") == a("parent")) & (b("node") > a("node")),
    "preceding-sibling": lambda a, b: (b("parent") == a("parent")) & (b("node") < a("node")),
}


def nodes_of(pages: DataFrame, page: str, nodes: Column) -> DataFrame:
    """A row a node, from an array of nodes (``page_nodes``)."""
    return pages.select(F.col(page).alias("page"), F.inline(nodes))


def roots(nodes: DataFrame) -> DataFrame:
    return nodes.where("node = 0")


def stepped(context: DataFrame, nodes: DataFrame, axis: str, tag: str | None = None, where: Column | None = None, nth: int | None = None) -> DataFrame:
    """The nodes, each once, that an axis leads to from any node of the context: elements with the tag (``*``: any element, ``#text``: texts, None: all), for which ``where`` holds.

    ``nth`` takes of those that a node leads to the n-th in the order of the page, of axes that lead back the n-th from the end.
    """
    found = {None: F.lit(True), "*": F.col("tag").isNotNull(), "#text": F.col("tag").isNull()}.get(tag, F.col("tag") == F.lit(tag))
    found = found & (F.col("tag").isNull() | (F.col("tag") != "") if tag else F.lit(True))
    target = nodes.where(found if where is None else found & where).alias("b")
    a, b = (lambda c: F.col(f"a.{c}")), (lambda c: F.col(f"b.{c}"))
    pairs = context.select("page", "node", "last", "parent").alias("a").join(target, (a("page") == b("page")) & AXES[axis](a, b))
    if nth is None:
        return nodes.join(pairs.select(F.col("b.page").alias("page"), F.col("b.node").alias("node")).distinct(), ["page", "node"], "left_semi").select(nodes.columns)
    back = axis.startswith(("ancestor", "preceding"))
    at = F.sort_array(F.collect_set("b.node"), asc=not back)
    picked = pairs.groupBy(a("page").alias("page"), a("node").alias("_from")).agg(F.get(at, nth - 1).alias("node")).select("page", "node").dropna().distinct()
    return nodes.join(picked, ["page", "node"], "left_semi").select(nodes.columns)


def along(nodes: DataFrame, *steps: tuple) -> DataFrame:
    """The nodes at the end of steps (axis, tag, condition, n-th; the last ones may be left out) from the pages' roots."""
    return reduce(lambda context, step: stepped(context, nodes, *step), steps, roots(nodes))


def having(context: DataFrame, nodes: DataFrame, *steps: tuple) -> DataFrame:
    """The nodes of the context from which steps lead anywhere: steps back from where they lead to are not asked for, each context node walks on its own."""
    walk = context.select("page", F.col("node").alias("_at"), "node", "last", "parent")
    for axis, tag, *more in steps:
        a, b = (lambda c: F.col(f"a.{c}")), (lambda c: F.col(f"b.{c}"))
        target = stepped(roots(nodes), nodes, "descendant", tag, *more[:1]).alias("b")
        walk = walk.alias("a").join(target, (a("page") == b("page")) & AXES[axis](a, b)).select(a("page").alias("page"), "_at", b("node").alias("node"), b("last").alias("last"), b("parent").alias("parent")).distinct()
    return context.join(walk.select("page", F.col("_at").alias("node")).distinct(), ["page", "node"], "left_semi").select(context.columns)


def string_values(context: DataFrame, nodes: DataFrame) -> DataFrame:
    """``page``, ``node``, ``value``: all text of each node and below it, in order; none is empty."""
    texts = nodes.where("tag IS NULL").select("page", F.col("node").alias("_text"), "text")
    own = context.select("page", "node", "last")
    pairs = own.join(texts, "page", "left").withColumn("text", F.when((F.col("_text") >= F.col("node")) & (F.col("_text") <= F.col("last")), F.col("text")))
    joined = F.array_join(F.transform(F.sort_array(F.collect_list(F.when(F.col("text").isNotNull(), F.struct("_text", "text")))), lambda x: x["text"]), "")
    return pairs.groupBy("page", "node").agg(joined.alias("value"))


def attribute(name: str) -> Column:
    return F.col("attributes")[name]
