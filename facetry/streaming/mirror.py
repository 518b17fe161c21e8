"""A mirror of a changing source, kept by a stream of changes: versions in folders of their own, and one pointer to those that count."""

from __future__ import annotations

import json
import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

BUCKETS = 16
POINTER = "_current.json"


class Mirror:
    """The newest state of each item, as Parquet files by bucket of items below a folder that all machines share.

    A batch of changes writes the buckets that it touches to a folder of its own; then the pointer, a small file that names each
    bucket's folder and the last batch, is replaced by one rename. A batch that breaks off before leaves the old state as it
    is; one that was taken already changes nothing.
    """

    def __init__(self, spark: SparkSession, folder: str, item: str, version: str, deleted: str | None = None, buckets: int = BUCKETS):
        """``version`` orders the changes of an item; ``deleted`` is a flag of those that remove it."""
        self.spark, self.folder, self.item, self.version, self.deleted, self.buckets = spark, folder.rstrip("/"), item, version, deleted, buckets

    def _files(self, path: str):
        hadoop = self.spark._jvm.org.apache.hadoop
        at = hadoop.fs.Path(path)
        return at, at.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def current(self) -> dict:
        at, files = self._files(f"{self.folder}/{POINTER}")
        if not files.exists(at):
            return {"batch": -1, "buckets": {}, "schema": None}
        stream = files.open(at)
        try:
            return json.loads(bytes(stream.readAllBytes()).decode())
        finally:
            stream.close()

    def _point(self, state: dict) -> None:
        """Replaces the pointer by one rename."""
        at, files = self._files(f"{self.folder}/{POINTER}")
        new, _ = self._files(f"{self.folder}/{POINTER}.{state['batch']}.{time.time_ns()}")
        out = files.create(new, True)
        out.write(json.dumps(state).encode())
        out.close()
        hadoop = self.spark._jvm.org.apache.hadoop.fs
        options = self.spark.sparkContext._gateway.new_array(hadoop.Options.Rename, 1)
        options[0] = hadoop.Options.Rename.OVERWRITE
        hadoop.FileContext.getFileContext(at.toUri(), self.spark._jsc.hadoopConfiguration()).rename(new, at, options)

    def rows(self, buckets=None, state: dict | None = None) -> DataFrame | None:
        """The current state; None before the first batch."""
        state = state or self.current()
        paths = sorted({p for b, p in state["buckets"].items() if buckets is None or int(b) in buckets})
        if state["schema"] is None:
            return None
        kinds = StructType.fromJson(state["schema"])
        return self.spark.read.schema(kinds).parquet(*paths) if paths else self.spark.createDataFrame([], kinds)

    def apply(self, changes: DataFrame, batch: int) -> bool:
        """Takes a batch of changes; false if it, or a later one, was taken before. Of an item's changes the newest counts, if it is newer than the state."""
        state = self.current()
        if batch <= state["batch"]:
            return False
        bucket = F.pmod(F.xxhash64(F.col(self.item).cast("string")), F.lit(self.buckets)).cast("int")
        others = [c for c in changes.columns if c not in (self.item, self.version)]
        newest = lambda rows: rows.groupBy(self.item).agg(F.max(F.struct(self.version, *others)).alias("x")).select(self.item, "x.*").select(changes.columns)
        changes = changes.where(F.col(self.item).isNotNull() & F.col(self.version).isNotNull())
        touched = sorted(r[0] for r in changes.select(bucket).distinct().collect())  # as many as there are buckets at most
        old = self.rows(set(touched), state)
        merged = newest(changes if old is None else old.unionByName(changes))
        folder = f"{self.folder}/batch={batch}-{time.time_ns()}"
        merged.withColumn("_bucket", bucket).repartition("_bucket").write.partitionBy("_bucket").parquet(folder)
        at, files = self._files(folder)
        have = {int(s.getPath().getName().removeprefix("_bucket=")) for s in files.listStatus(at) if s.getPath().getName().startswith("_bucket=")}
        paths = {b: p for b, p in state["buckets"].items() if int(b) not in touched} | {str(b): f"{folder}/_bucket={b}" for b in touched if b in have}
        self._point({"batch": batch, "buckets": paths, "schema": json.loads(changes.schema.json())})
        return True

    def items(self) -> DataFrame | None:
        """The items that aren't deleted."""
        rows = self.rows()
        return rows if rows is None or self.deleted is None else rows.where(~F.coalesce(F.col(self.deleted), F.lit(False))).drop(self.deleted)

    def follow(self, changes: DataFrame, checkpoint: str, **trigger):
        """Keeps the mirror from a stream of changes; a batch that is played again is told by its number."""
        return changes.writeStream.foreachBatch(lambda rows, batch: self.apply(rows, batch)).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def once(changes: DataFrame, keys: list[str], time_column: str, late: str) -> DataFrame:
    """The changes of a stream without those whose keys came before within the lateness, by keyed state that the watermark clears; of a table, without repeated ones."""
    if changes.isStreaming:
        return changes.withWatermark(time_column, late).dropDuplicatesWithinWatermark(keys)
    return changes.dropDuplicates(keys)
