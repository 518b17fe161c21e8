"""Python functions over Arrow batches a slice at a time, so that what Python holds at once is bounded by bytes of input, not by a batch's rows."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

#: Bytes of text that a slice has, unless one row has more.
MOST = 1 << 19
_IN = "_sliced"


def slices(batch: pa.RecordBatch, column: str, most: int = MOST) -> Iterator[pa.RecordBatch]:
    """Runs of a batch's rows with up to ``most`` bytes in a column of texts, one row at least."""
    sizes = np.cumsum(pc.fill_null(pc.binary_length(batch[column]), 0).to_numpy(zero_copy_only=False).astype(np.int64) + 8)
    at = 0
    while at < batch.num_rows:
        to = max(at + 1, int(np.searchsorted(sizes, (sizes[at - 1] if at else 0) + most, "right")))
        yield batch.slice(at, to - at)
        at = to


def in_slices(values: pa.Array, run: Callable[[pa.Array], pa.Array]) -> pa.Array:
    """What ``run`` gives for an array of texts, slice by slice."""
    parts = [run(part["x"]) for part in slices(pa.RecordBatch.from_arrays([values], ["x"]), "x")]
    return pa.concat_arrays(parts) if parts else run(values)


def with_column(rows: DataFrame, name: str, text: Column, run: Callable[[pa.Array], pa.Array], kind: str) -> DataFrame:
    """Adds what ``run`` gives for a column of texts, one value a row."""
    schema = T.StructType([*(f for f in rows.schema if f.name != name), T.StructField(name, T.DataType.fromDDL(kind))])
    keep, arrow = [f.name for f in schema][:-1], to_arrow_schema(schema)

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, _IN):
                yield pa.RecordBatch.from_arrays([*(part[k] for k in keep), run(part[_IN]).cast(arrow.field(name).type)], schema=arrow)

    return rows.select(*keep, text.alias(_IN)).mapInArrow(each, schema)


def exploded(rows: DataFrame, keep: list[str], text: Column, run: Callable[[pa.Array], pa.Array], kind: str, at: str | None = None) -> DataFrame:
    """A row for each struct of the arrays that ``run`` gives for a column of texts: the columns to keep, its place in the array (``at``, if named), and its fields. Null and empty arrays vanish."""
    element = T.DataType.fromDDL(kind).elementType
    schema = T.StructType([*(rows.schema[k] for k in keep), *([T.StructField(at, T.IntegerType())] if at else []), *element])
    arrow = to_arrow_schema(schema)

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, _IN):
                found = run(part[_IN])
                owner, flat = pc.list_parent_indices(found), found.flatten()
                sizes = pc.fill_null(found.value_lengths(), 0).to_numpy(zero_copy_only=False).astype(np.int64)
                place = [pa.array((np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)).astype(np.int32))] if at else []
                columns = [*(part[k].take(owner) for k in keep), *place, *flat.flatten()]
                yield pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(columns, arrow, strict=True)], schema=arrow)

    return rows.select(*keep, text.alias(_IN)).mapInArrow(each, schema)
