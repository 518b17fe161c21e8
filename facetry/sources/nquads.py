"""Statements as N-Quads lines: formatting and parsing as columns, reading and writing as text files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A subject and predicate, an object (IRI, blank node, or literal with tag or type) and maybe a graph.
LINE = r'^\s*(<[^>]*>|_:\S+)\s+<([^>]*)>\s+(<[^>]*>|_:\S+|"((?:[^"\\]|\\.)*)"(?:@([A-Za-z0-9-]+)|\^\^<([^>]*)>)?)\s*(?:<([^>]*)>)?\s*\.\s*(?:#.*)?$'
#: Characters that a literal escapes, and their escapes; the backslash is first.
ESCAPES = (("\\", "\\\\"), ('"', '\\"'), ("\n", "\\n"), ("\r", "\\r"), ("\t", "\\t"))
#: Stands for an escaped backslash while other escapes are undone.
MARK = "\x00"


def escaped(c: Column) -> Column:
    for plain, code in ESCAPES:
        c = F.replace(c, F.lit(plain), F.lit(code))
    return c


def unescaped(c: Column) -> Column:
    c = F.replace(c, F.lit("\\\\"), F.lit(MARK))
    for plain, code in ESCAPES[1:]:
        c = F.replace(c, F.lit(code), F.lit(plain))
    codes = F.array_distinct(F.regexp_extract_all(c, F.lit(r"\\u([0-9A-Fa-f]{4})"), F.lit(1)))
    c = F.aggregate(codes, c, lambda text, code: F.replace(text, F.concat(F.lit("\\u"), code), F.decode(F.unhex(code), "UTF-16BE")))
    return F.replace(c, F.lit(MARK), F.lit("\\"))


def formatted(statements: DataFrame) -> DataFrame:
    """A ``value`` line for each statement of s (an IRI or blank node), IRI p, object o and graph, which may be null.

    The columns ``kind`` (iri, blank or literal), ``lang`` and ``datatype`` of an object are used where they are there; else it is a plain literal.
    """
    iri = lambda c: F.concat(F.lit("<"), c, F.lit(">"))
    column = lambda name: F.col(name) if name in statements.columns else F.lit(None).cast("string")
    tag, kind = column("lang"), F.coalesce(column("kind"), F.lit("literal"))
    end = F.when(tag.isNotNull(), F.concat(F.lit("@"), tag)).when(column("datatype").isNotNull(), F.concat(F.lit("^^"), iri(column("datatype")))).otherwise("")
    thing = F.when(kind == "iri", iri(F.col("o"))).when(kind == "blank", F.col("o")).otherwise(F.concat(F.lit('"'), escaped(F.col("o")), F.lit('"'), end))
    subject = F.when(F.col("s").startswith("_:"), F.col("s")).otherwise(iri(F.col("s")))
    return statements.select(F.concat_ws(" ", subject, iri(F.col("p")), thing, iri(F.col("graph")), F.lit(".")).alias("value"))


def one_graph(statements: DataFrame, graph: str | None) -> DataFrame:
    """The lines of one graph's statements, without its name; the default graph for None."""
    return formatted(statements.where(F.col("graph").eqNullSafe(F.lit(graph))).withColumn("graph", F.lit(None).cast("string")))


def parsed(lines: DataFrame) -> DataFrame:
    """``graph``, ``s``, ``p``, ``o``, and the object's ``kind``, ``lang`` and ``datatype``; lines that aren't statements are left out."""
    part = lambda i: F.regexp_extract("value", LINE, i)
    absent = lambda i: F.when(part(i) != "", part(i))
    bare = lambda c: F.when(c.startswith("<"), F.substring(c, F.lit(2), F.length(c) - 2)).otherwise(c)
    thing = part(3)
    kind = F.when(thing.startswith("<"), "iri").when(thing.startswith("_:"), "blank").otherwise("literal")
    o = F.when(kind == "literal", unescaped(part(4))).otherwise(bare(thing))
    return lines.where(F.col("value").rlike(LINE)).select(absent(7).alias("graph"), bare(part(1)).alias("s"), part(2).alias("p"), o.alias("o"), kind.alias("kind"), absent(5).alias("lang"), absent(6).alias("datatype"))


def read_nquads(spark: SparkSession, path: str) -> DataFrame:
    return parsed(spark.read.text(path))


def write_nquads(statements: DataFrame, path: str, mode: str = "errorifexists") -> None:
    formatted(statements).write.mode(mode).text(path)
