"""What the corpus operators share: reading texts in Arrow batches and splitting them into words."""

from __future__ import annotations

import math
import struct
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from facetry.operators.durable import checkpoint_folder, durable

#: A word is a run of characters other than space and the five ASCII line and tab controls.
WORD = r"[^\x20\x09-\x0D]+"

#: Bytes of a table that may be sent to all tasks.
MOST_SENT = 32 << 20

#: Rows of a batch that are handled at once.
FEW_ROWS = 1024


def documents(spark: SparkSession, sf_dir: str, table: str = "documents") -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def map_rows(df: DataFrame, make: Callable[[], Callable[[pa.RecordBatch], dict | None]], schema: str | T.StructType) -> DataFrame:
    """Applies a function to FEW_ROWS rows of each Arrow batch at a time; ``make()`` builds it once a task, so it can hold caches.

    The function returns columns by name (lists, numpy or Arrow arrays), or None for no rows.
    """
    kinds = schema if isinstance(schema, T.StructType) else T._parse_datatype_string(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        arrow, each = to_arrow_schema(kinds), make()
        for batch in batches:
            for i in range(0, batch.num_rows, FEW_ROWS):  # so that what a task holds beside a batch stays small
                if (found := each(batch.slice(i, FEW_ROWS))) is not None:
                    yield record_batch(found, arrow)
        if (last := getattr(each, "finish", None)) and (found := last()) is not None:
            yield record_batch(found, arrow)
        release()

    return df.mapInArrow(run, kinds)


def release() -> None:
    """Gives memory that a task has freed back to the system, as its worker lives on beside others."""
    import ctypes

    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):  # of the GNU library
        trim(0)


def record_batch(found: dict, arrow: pa.Schema) -> pa.RecordBatch:
    columns = [x if isinstance(x, pa.Array) and x.type == f.type else x.cast(f.type) if isinstance(x, pa.Array) else pa.array(x, f.type) for f in arrow for x in [found[f.name]]]
    return pa.RecordBatch.from_arrays(columns, schema=arrow)


def keyed(df: DataFrame, id_col: str, text_col: str, **more: Column) -> DataFrame:
    """The identifier and the text's UTF-8 bytes, nothing else; a column that clashes with a name used inside stays outside."""
    return df.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").cast("string").cast("binary").alias("text"), *(c.alias(k) for k, c in more.items()))


def id_type(df: DataFrame, id_col: str) -> str:
    return df.select(F.col(f"`{id_col}`")).schema[0].dataType.simpleString()


def bucket_of(column: Column, divisor: int) -> Column:
    """crc32 of the value as text, modulo the divisor; null for null."""
    return F.pmod(F.crc32(column.cast("string").cast("binary")), F.lit(divisor))


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)).cast("long"), F.lit(0).cast("long"))


def null_safe(joined: tuple[str, ...], left: str, right: str) -> Column:
    """Equality of the named columns of two aliased frames, null equal to null."""
    out = F.lit(True)
    for name in joined:
        out = out & F.col(f"{left}.{name}").eqNullSafe(F.col(f"{right}.{name}"))
    return out


def parallelism(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def checkpointed(df: DataFrame) -> DataFrame:
    """Cuts the lineage through the shared folder that the cluster names in spark.checkpoint.dir; an error where a cluster names none."""
    return durable(df)


def shared_folder(spark: SparkSession) -> str:
    """A new folder's path inside the shared checkpoint folder."""
    import uuid

    return f"{checkpoint_folder(spark)}/{uuid.uuid4().hex}"


def numbered(docs: DataFrame) -> DataFrame:
    """``row``, a number that no other row has, and ``of``, all columns.

    Rows read from files have the number of their file and their place in it. Others are written to the shared folder first, so
    that their numbers stay.
    """
    of = F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("of")
    try:
        if "_metadata" in docs.columns:
            raise AnalysisException("a column of that name")
        placed = docs.select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.row_index").alias("at"), of)
    except AnalysisException:
        folder = shared_folder(docs.sparkSession)
        docs.select(F.monotonically_increasing_id().alias("row"), of).write.parquet(folder)
        return docs.sparkSession.read.parquet(folder)
    paths = sorted(r.path for r in placed.select("path").distinct().collect())  # the driver lists the files anyway
    files = docs.sparkSession.createDataFrame(list(enumerate(paths)), "file long, path string")
    files = files.hint("broadcast") if sum(map(len, paths)) <= MOST_SENT else files
    return placed.join(files, "path").select(F.shiftleft("file", 40).bitwiseOR(F.col("at")).alias("row"), "of")


def entropy(counts) -> float:
    total = sum(counts)
    return -sum(c / total * math.log2(c / total) for c in counts if c) if total else 0.0


def pack(values) -> bytes:
    return struct.pack(f"<{len(values)}q", *values)
