"""Row positions, length order and micro-batches."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpus_spark.session import staged

# monotonically_increasing_id keeps the partition in the high bits and the row in the low 33.
_ROW_BITS = 33


# A column that says where in which file a row stood; readers add it, positions are taken from it.
POSITION = "__position"


def file_position(df: DataFrame) -> Column | None:
    """Where each row stood: file, then place in the file, a struct that sorts in file order.

    From the column a reader added, else from what Parquet files say of their rows. Neither depends
    on how files are split or packed into tasks. None where the frame does not come from such files.
    """
    if POSITION in df.columns:
        return F.col(POSITION)
    row = F.struct(F.col("_metadata.file_path"), F.col("_metadata.row_index"))
    try:
        df.select(row)
    except AnalysisException:
        return None
    return row


def with_row_index(df: DataFrame, *order_by: Column, name: str = "row_index") -> DataFrame:
    """Dense positions 0, 1, 2, ... in the given total order, or in file order without one.

    File order is by path, and within a file as its rows stand. A frame that was not read from
    Parquet, or by a reader that keeps positions, has no such order and needs order columns.

    Rows are range-partitioned on the order, numbered inside their partition, and shifted by the
    row counts of the partitions before. The placement is staged first, because range bounds come
    from a sample and both passes must see the same ones. The joined offsets are one row per
    partition, so broadcasting them is bounded by the task count, not by the data. End the order
    on a unique column: equal keys share one partition. All columns of the frame are staged, so hand
    in keys rather than texts where texts are not needed.
    """
    if not order_by:
        place = file_position(df)
        if place is None:
            raise ValueError("Rows have no file order: give order columns, or read with positions")
        df = df.withColumn(POSITION, place)
        order_by = (F.col(POSITION),)
    df = df.repartitionByRange(*order_by).sortWithinPartitions(*order_by).drop(POSITION)
    slot = F.col("__slot")
    part = F.shiftright(slot, _ROW_BITS)
    placed = staged(df.withColumn("__slot", F.monotonically_increasing_id()))
    before = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        placed.groupBy(part.alias("__part")).agg(F.count(F.lit(1)).alias("__rows"))
        .select("__part", F.coalesce(F.sum("__rows").over(before), F.lit(0)).alias("__before"))
    )
    local = slot.bitwiseAND(F.lit((1 << _ROW_BITS) - 1))
    return (
        placed.withColumn("__part", part)
        .join(F.broadcast(offsets), "__part")
        .withColumn(name, F.col("__before") + local)
        .drop("__slot", "__part", "__before")
    )


def sort_by_length(df: DataFrame, text: str, tie: str, *more: str) -> DataFrame:
    """Global length order as ranges of partitions; the tie columns, unique together, keep one length
    from filling a partition."""
    order = [F.length(text), F.col(tie), *[F.col(name) for name in more]]
    return df.repartitionByRange(*order).sortWithinPartitions(*order)


def length_batches(df: DataFrame, length: Column, *tie: str, batch_size: int = 8) -> DataFrame:
    """Exact micro-batches: ``batch_pos`` is the position in global length order, ``batch_id`` its
    group of ``batch_size``. All columns of the frame are staged, so hand in the length and the ids
    rather than the texts where the texts are not needed."""
    indexed = with_row_index(df, length, *[F.col(name) for name in tie], name="batch_pos")
    return indexed.withColumn("batch_id", F.floor(F.col("batch_pos") / batch_size))


def restore_order(df: DataFrame, position: str) -> DataFrame:
    """Back to the original order, for a sink that shows it."""
    return df.orderBy(position)
