"""Graph patterns over statements (graph, s, p, o) as DataFrames of bindings, a column for each variable."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from facetry.operators.graph import closure


def matched(store: DataFrame, s: str, p: str, o: str, graph: str | None = None) -> DataFrame:
    """Bindings of one pattern: ``?x`` is a variable, anything else a constant, which is filtered at the scan. With a ``graph``, statements of named graphs only: of that one, or with the graph's name as a variable."""
    seen: dict[str, str] = {}
    if graph is not None:
        store = store.where(F.col("graph").isNotNull())
    for column, x in (*((("graph", graph),) if graph is not None else ()), ("s", s), ("p", p), ("o", o)):
        if not x.startswith("?"):
            store = store.where(F.col(column) == F.lit(x))
        elif x in seen:
            store = store.where(F.col(column) == F.col(seen[x]))
        else:
            seen[x] = column
    return store.select(*(F.col(c).alias(v[1:]) for v, c in seen.items()))


def shared(left: DataFrame, right: DataFrame) -> list[str]:
    """The variables of both; patterns that share none would multiply, which is an error."""
    names = [c for c in left.columns if c in right.columns]
    if not names:
        raise ValueError("patterns without a common variable")
    return names


def both(left: DataFrame, right: DataFrame) -> DataFrame:
    return left.join(right, shared(left, right))


def group(store: DataFrame, *patterns: tuple[str, str, str]) -> DataFrame:
    """Bindings that all patterns agree on; each shares a variable with those before it."""
    return reduce(both, (matched(store, *x) for x in patterns))


def optional(left: DataFrame, right: DataFrame) -> DataFrame:
    return left.join(right, shared(left, right), "left")


def either(left: DataFrame, right: DataFrame) -> DataFrame:
    """Bindings of one or the other, as often as they occur; variables that one lacks are null."""
    return left.unionByName(right, allowMissingColumns=True)


def without(left: DataFrame, right: DataFrame) -> DataFrame:
    return left.join(right, shared(left, right), "left_anti")


def having(left: DataFrame, right: DataFrame) -> DataFrame:
    return left.join(right, shared(left, right), "left_semi")


def along(store: DataFrame, *path: str, start: str = "start", end: str = "end") -> DataFrame:
    """Pairs that a chain of predicates joins; a predicate with ``^`` before it is walked backward."""
    rows = None
    for k, p in enumerate(path):
        a, b = f"?_{k}", f"?_{k + 1}"
        step = matched(store, b, p[1:], a) if p.startswith("^") else matched(store, a, p, b)
        rows = step if rows is None else both(rows, step)
    return rows.select(F.col("_0").alias(start), F.col(f"_{len(path)}").alias(end))


def any_of(store: DataFrame, *predicates: str, start: str = "start", end: str = "end") -> DataFrame:
    """Pairs that any of the predicates joins, as often as they do."""
    return reduce(DataFrame.union, (along(store, p, start=start, end=end) for p in predicates))


def repeated(store: DataFrame, predicate: str, start: str = "start", end: str = "end", zero: bool = False) -> DataFrame:
    """Pairs joined by the predicate one or more times; with ``zero``, also each subject or object with itself."""
    found = closure(along(store, predicate, start="a", end="b").distinct())
    if zero:
        ends = store.where(F.col("p") == predicate.lstrip("^"))
        found = found.union(ends.select(F.explode(F.array("s", "o")).alias("a")).select("a", F.col("a").alias("b"))).distinct()
    return found.select(F.col("a").alias(start), F.col("b").alias(end))


def values(left: DataFrame, **columns: list) -> DataFrame:
    """Bindings that agree with a row of a small inline table, given by columns; None agrees with anything."""
    test = F.lit(False)
    for row in zip(*columns.values(), strict=True):
        test = test | reduce(lambda a, b: a & b, (F.col(k) == F.lit(v) for k, v in zip(columns, row, strict=True) if v is not None), F.lit(True))
    return left.where(test)


def in_graphs(store: DataFrame, *graphs: str) -> DataFrame:
    """The statements of the graphs, each once: as one graph, whatever graphs hold it."""
    return store.where(F.col("graph").isin(*graphs)).select("s", "p", "o").distinct()


def from_named(store: DataFrame, *graphs: str) -> DataFrame:
    """The statements of the named graphs, which patterns with a graph see."""
    return store.where(F.col("graph").isin(*graphs))


def bound_to(rows: DataFrame, **values) -> DataFrame:
    """Bindings in which the variables have the given values."""
    return rows.where(reduce(lambda a, b: a & b, (F.col(k) == F.lit(v) for k, v in values.items()), F.lit(True)))


def described(store: DataFrame, subjects: DataFrame) -> DataFrame:
    """All statements about the subjects ``s``, and those that name them as object."""
    wanted = subjects.select(F.col("s").alias("_s")).distinct()
    about = store.join(wanted, F.col("s") == F.col("_s"), "left_semi")
    return about.union(store.join(wanted, F.col("o") == F.col("_s"), "left_semi")).distinct()


def constructed(rows: DataFrame, *templates: tuple[str, str, str]) -> DataFrame:
    """The statements that the templates give for each binding, as a set; those with an unbound variable are left out."""
    term = lambda x: F.col(x[1:]) if x.startswith("?") else F.lit(x)
    made = F.explode(F.array(*(F.struct(*(term(x).alias(k) for k, x in zip("spo", t, strict=True))) for t in templates)))
    return rows.select(made.alias("x")).select("x.s", "x.p", "x.o").dropna().distinct()


def asked(rows: DataFrame) -> DataFrame:
    """One row: whether there is any binding."""
    return rows.limit(1).agg((F.count("*") > 0).alias("ask"))
