"""Values of mixed kinds: their total order, conversions that give null instead of an error, and marks taken off texts."""

from __future__ import annotations

import unicodedata

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Kinds in rising order; a missing value comes before all.
KINDS = ("blank", "iri", "boolean", "number", "date", "string")


def sort_key(kind: Column, text: Column) -> Column:
    """A struct that orders values: by kind, then by number or date; those malformed for their kind come last in it, then by text."""
    rank = F.coalesce(F.array_position(F.lit(list(KINDS)), kind).cast("int"), F.lit(0))
    number, date = text.try_cast("double"), text.try_cast("timestamp")
    malformed = F.when(kind == "number", number.isNull()).when(kind == "date", date.isNull()).otherwise(F.lit(False))
    return F.struct(rank.alias("rank"), F.coalesce(malformed, F.lit(False)).alias("malformed"), F.when(kind == "number", number).alias("number"), F.when(kind == "date", date).alias("date"), text.alias("text"))


def least(kind: Column, text: Column) -> Column:
    return F.min_by(text, sort_key(kind, text))


def greatest(kind: Column, text: Column) -> Column:
    return F.max_by(text, sort_key(kind, text))


@F.pandas_udf(T.StringType())
def without_marks(texts: pd.Series) -> pd.Series:
    """Letters without their marks; no built-in function decomposes characters."""
    return texts.map(lambda t: t if t is None or t.isascii() else bare(t))


def bare(text: str) -> str:
    return unicodedata.normalize("NFC", "".join(c for c in unicodedata.normalize("NFD", text) if not unicodedata.combining(c)))


def bare_texts(texts: pa.Array) -> pa.Array:
    """``without_marks`` of a slice of texts."""
    return pa.array([t if t is None or t.isascii() else bare(t) for t in texts.to_pylist()], pa.string())
