"""Token counts from an exact histogram of encoded lengths."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from facetry.llm.texts import keyed, map_rows
from facetry.llm.vocabularies import FOLDER, broadcast_file, byte_bpe

#: Lengths of one block are summed in one task.
BLOCK = 1024


def encoded_lengths(docs: DataFrame, text_col: str = "text", vocabulary: str = f"{FOLDER}/byte_bpe_50k.tiktoken") -> DataFrame:
    """``n_tokens`` of each row; null and empty texts have 0."""
    ranks = broadcast_file(docs.sparkSession, vocabulary)

    def make():
        encoding = byte_bpe(ranks.value)
        return lambda batch: {"n_tokens": [len(encoding.encode_ordinary(x.decode("utf-8", "replace"))) if x else 0 for x in batch["text"].to_pylist()]}

    return map_rows(keyed(docs, text_col, text_col), make, "n_tokens long")


def length_histogram(lengths: DataFrame) -> DataFrame:
    """One row for each encoded length: ``n_tokens`` and ``n_docs``."""
    return lengths.groupBy("n_tokens").agg(F.count("*").alias("n_docs"))


def length_table(histogram: DataFrame) -> DataFrame:
    """What the histogram's suffix sums answer, a row for each length as a context limit.

    ``n_docs_ge`` and ``tokens_ge``: documents at least so long, and their tokens; ``tokens_truncated``: all tokens if
    each document is cut at this length; ``tokens_dropped``: the rest; ``n_docs_le`` and ``quantile``: documents at most
    so long, and their share. An empty histogram gives no rows. Sums run within blocks of lengths; only one row a block
    meets in one task.
    """
    h = histogram.select(F.col("n_tokens").cast("long"), F.col("n_docs").cast("long")).withColumn("block", F.floor(F.col("n_tokens") / BLOCK)).withColumn("tokens", F.col("n_tokens") * F.col("n_docs"))
    sums = h.groupBy("block").agg(F.sum("n_docs").alias("block_docs"), F.sum("tokens").alias("block_tokens"))
    above = Window.orderBy(F.col("block").desc()).rowsBetween(Window.unboundedPreceding, -1)
    every = Window.orderBy(F.col("block").desc()).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    sums = sums.select("block", *(F.coalesce(F.sum(f"block_{k}").over(above), F.lit(0).cast("long")).alias(f"{k}_above") for k in ("docs", "tokens")), *(F.sum(f"block_{k}").over(every).alias(f"all_{k}") for k in ("docs", "tokens")))
    within = Window.partitionBy("block").orderBy(F.col("n_tokens").desc())
    out = h.join(sums, "block").withColumn("n_docs_ge", F.sum("n_docs").over(within) + F.col("docs_above")).withColumn("tokens_ge", F.sum("tokens").over(within) + F.col("tokens_above"))
    cut = F.col("all_tokens") - F.col("tokens_ge") + F.col("n_tokens") * F.col("n_docs_ge")
    under = F.col("all_docs") - F.col("n_docs_ge") + F.col("n_docs")
    return out.select("n_tokens", "n_docs", "n_docs_ge", "tokens_ge", cut.alias("tokens_truncated"), (F.col("all_tokens") - cut).alias("tokens_dropped"), under.alias("n_docs_le"), (under / F.col("all_docs")).alias("quantile"))


def total_at(table: DataFrame, limit: int) -> DataFrame:
    """Documents over any context limit, and all tokens if each document is cut at it: one row, from the next greater length."""
    over = table.where(F.col("n_tokens") > limit).agg(F.max("n_docs_ge").alias("n_docs_over"), F.max("tokens_ge").alias("tokens_over"))
    total = table.agg(F.max("tokens_ge").alias("tokens"))
    zero = F.lit(0).cast("long")
    return over.join(total).select(F.coalesce("n_docs_over", zero).alias("n_docs_over"), (F.coalesce("tokens", zero) - F.coalesce("tokens_over", zero) + limit * F.coalesce("n_docs_over", zero)).alias("tokens_truncated"))


def length_quantile(table: DataFrame, share: float) -> DataFrame:
    """The least length that at least this share of documents don't exceed."""
    return table.where(F.col("quantile") >= share).agg(F.min("n_tokens").alias("n_tokens"))
