"""A corpus from raw documents: stages that each apply one corpus operator to all that the one before it kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from facetry.llm import mixing, near_copies, quality, queries, suffixes
from facetry.llm.texts import shared_folder

#: Bytes of the shortest passage that is cut when it repeats: below that of any 51 words of prose (six bytes a word or so).
PASSAGE = 250


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, fitted on the labelled ones among them, scores at least even."""
    return quality.high_quality(docs, quality.fit_quality(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def keep_first_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that of the smallest identifier, of each group of linked fingerprints or shingle sets."""
    return near_copies.first_of_near_copies(docs)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the passages of PASSAGE bytes or more that occur earlier; every document stays, a null text null."""
    names = docs.columns
    found = suffixes.without_repeats(docs, carry=tuple(names), length=PASSAGE)
    text = F.when(F.col(f"row_{names.index('text')}").isNotNull(), F.col("kept").cast("string"))
    new = {"text": text, "n_chars": F.length(text).cast("long")}
    return found.select(*(new.get(c, F.col(f"row_{i}")).alias(c) for i, c in enumerate(names)))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as its source's rate has it."""
    return mixing.mixed(docs)


def segment(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The piece counts, scores and decoding check of each document."""
    return queries.segmented(docs)


STAGES = [("quality classifier", keep_quality), ("simhash near-dedup", keep_first_copies), ("suffix-array dedup", cut_repeats), ("source mixing", mix_sources), ("sentencepiece", segment)]

#: Scores, fingerprints and suffix order have no SQL form.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents; each but the last is written to the shared folder and read again."""
    docs, folder = spark.read.parquet(f"{sf_dir}/documents.parquet"), shared_folder(spark)
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs.write.parquet(f"{folder}/{k}")
            docs = spark.read.parquet(f"{folder}/{k}")
    return docs
