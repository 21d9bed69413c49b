"""Columns computed in Python, Arrow batch by Arrow batch, without a shuffle."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import StructType

# Rows handed to one call hold about this much of the source column, or one row that holds more.
SLICE_BYTES = 8 << 20
# Batches from the JVM are bounded in bytes, because they stand in memory on both sides.
BATCH_BYTES = 8 << 20

Batches = Iterator[pa.RecordBatch]


def map_arrow(df: DataFrame, run: Callable[[Batches], Batches], schema: StructType | str) -> DataFrame:
    """``mapInArrow`` with batches of at most about ``BATCH_BYTES``, or one row that is larger.

    Sets the session's bound. Python workers outlive their tasks, and an executor may keep several for each core, so at
    its end a task gives back what Arrow's memory pool still holds of its batches.
    """

    def released(batches: Batches) -> Batches:
        yield from run(batches)
        pa.default_memory_pool().release_unused()

    df.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    return df.mapInArrow(released, schema)


def slices(batch: pa.RecordBatch, place: int, most: int = SLICE_BYTES) -> Batches:
    """The batch cut where the values of the column at ``place`` add up to ``most`` bytes."""
    start, held = 0, 0
    for row, size in enumerate(pc.binary_length(batch.column(place)).to_pylist()):
        if held and held + (size or 0) > most:
            yield batch.slice(start, row - start)
            start, held = row, 0
        held += size or 0
    if start < batch.num_rows:
        yield batch.slice(start)


def add_columns(
    df: DataFrame,
    source: str,
    fields: str,
    make: Callable[[], Callable[[list], dict[str, list]]],
    most: int = SLICE_BYTES,
) -> DataFrame:
    """The frame with new columns computed from one text or binary column.

    ``make`` runs once per task and returns the function from a list of values to the new columns.
    All columns pass through, the source too; one already named as a new one, in any case, is
    replaced. So a new column must not have the name of the source.
    """
    added = StructType.fromDDL(fields)
    taken = {name.lower() for name in added.names}
    if source.lower() in taken:
        raise ValueError(f"column {source} is read, so it cannot be written too")
    kept = df.select(*[F.col(f"`{name}`") for name in df.columns if name.lower() not in taken])
    place = [name.lower() for name in kept.columns].index(source.lower())
    schema = StructType([*kept.schema.fields, *added.fields])
    types = {field.name: to_arrow_type(field.dataType) for field in added.fields}

    def run(batches: Batches) -> Batches:
        function = make()
        for batch in batches:
            for part in slices(batch, place, most):
                found = function(part.column(place).to_pylist())
                arrays = [*part.columns, *[pa.array(found[name], kind) for name, kind in types.items()]]
                yield pa.RecordBatch.from_arrays(arrays, schema.names)

    return map_arrow(kept, run, schema)


def packed(values: np.ndarray) -> bytes:
    """Small whole numbers as bytes: the first bytes of all, then the second ones, compressed."""
    plane = np.ascontiguousarray(values.astype("<u4").view(np.uint8).reshape(-1, 4).T).tobytes()
    return pa.compress(plane, codec="zstd", asbytes=True)


def unpacked(packed: bytes, size: int) -> np.ndarray:
    plane = pa.decompress(packed, decompressed_size=4 * size, codec="zstd", asbytes=True) if size else b""
    return np.ascontiguousarray(np.frombuffer(plane, np.uint8).reshape(4, -1).T).view("<u4").ravel().astype(np.int64)


def one_list(values: pa.Array) -> pa.Array:
    """All values as the one list of one row."""
    return pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), values)
