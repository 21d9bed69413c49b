"""Seeded orders, document-level splits and subsets.

Every order here is by the MD5 of seed and key, so it depends on nothing but the data: any
partitioning, any engine and any re-run give the same split.
"""

from __future__ import annotations

import warnings

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpus_spark.operators.columns import SPLIT_KEY_ALIASES, column, find_column
from corpus_spark.operators.indexing import POSITION, file_position

# Fixed values.
VAL_FRACTION = 0.10
SEED = 42
SMALL_ROWS = 100

_BUCKET_DIGITS = 4


def split_rank(key: Column, seed: int = SEED) -> Column:
    """Order key of a document: 32 hex digits. Null keys form one document."""
    return F.md5(F.coalesce(F.concat(F.lit(f"{seed}:"), key.cast("string")), F.lit(str(seed))).cast("binary"))


def distinct_keys(df: DataFrame, key: str) -> DataFrame:
    """The document ids; a hot id is collapsed before the shuffle."""
    return df.select(column(key).alias(key)).distinct()


def seeded_shuffle(df: DataFrame, key: str, *tie: str, seed: int = SEED) -> DataFrame:
    """Rows in seeded order of a key. The tie columns order rows that share a key and let the sort cut
    a hot key into several ranges; where none are named all columns that sort break the tie."""
    tie = tie or tuple(f.name for f in df.schema.fields if f.name != key and f.dataType.typeName() not in ("map", "variant"))
    return df.orderBy(split_rank(column(key), seed), column(key), *[column(name) for name in tie])


def held_out_cutoff(ranks: DataFrame, fraction: float = VAL_FRACTION) -> DataFrame:
    """One row with the rank of the last held-out document, ``max(1, int(n * fraction))`` from the start.

    ``ranks`` has one distinct ``rank`` per document. A histogram over the leading digits (65,536
    rows whatever the data) shows which bucket holds the cutoff, and only that bucket, about one
    65,536th of the documents, is numbered. So the exact cutoff needs neither a global sort nor a
    top-k the size of the held-out set.
    """
    bucket = F.substring("rank", 1, _BUCKET_DIGITS)
    sizes = ranks.groupBy(bucket.alias("bucket")).agg(F.count(F.lit(1)).alias("n"))
    running = sizes.select(
        "bucket", "n",
        F.sum("n").over(Window.orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0)).alias("upto"),
        F.sum("n").over(Window.partitionBy()).alias("total"),
    )
    wanted = F.greatest(F.lit(1), F.floor(F.col("total") * F.lit(fraction)))
    edge = running.filter((F.col("upto") >= wanted) & (F.col("upto") - F.col("n") < wanted)).select(
        F.col("bucket").alias("edge_bucket"), (wanted - F.col("upto") + F.col("n")).alias("nth")
    )
    numbered = (
        ranks.join(F.broadcast(edge), bucket == F.col("edge_bucket"))
        .withColumn("place", F.row_number().over(Window.partitionBy("edge_bucket").orderBy("rank")))
    )
    return numbered.filter(F.col("place") == F.col("nth")).select("rank")


def _label(df: DataFrame, rank: Column, ranks: DataFrame, fraction: float) -> DataFrame:
    cutoff = held_out_cutoff(ranks, fraction).scalar()
    return df.withColumn("split", F.when(rank <= cutoff, F.lit("val")).otherwise(F.lit("train")))


def document_split(df: DataFrame, key: str, fraction: float = VAL_FRACTION, seed: int = SEED) -> DataFrame:
    """Label every row ``train`` or ``val`` so that no document is in both parts.

    The held-out share of documents is exact. Labelling is a comparison with one value, so the
    rows are neither joined nor shuffled, however many a document has.
    """
    ranks = distinct_keys(df, key).select(split_rank(column(key), seed).alias("rank"))
    return _label(df, split_rank(column(key), seed), ranks, fraction)


def row_split(df: DataFrame, key: str | None = None, fraction: float = VAL_FRACTION, seed: int = SEED) -> DataFrame:
    """The same on rows: by a unique row key, or by file and position in it where there is none.

    Without a key the rank is a hash of where the row stood, so any number of tasks gives the same
    split and nothing is staged; a frame without such positions needs a key.
    """
    if key is None:
        place = file_position(df)
        if place is None:
            raise ValueError("Rows have no file position: give a key, or read with positions")
        placed = df.withColumn("__place", place.cast("string"))
        return row_split(placed, "__place", fraction, seed).drop("__place", POSITION)
    rank = split_rank(column(key), seed)
    return _label(df, rank, df.select(rank.alias("rank")), fraction)


def auto_split(df: DataFrame, fraction: float = VAL_FRACTION, seed: int = SEED) -> DataFrame:
    """By document id where the frame has one, else by row."""
    key = find_column(df, *SPLIT_KEY_ALIASES)
    if key is None:
        warnings.warn("No document id column: rows are split one by one", stacklevel=2)
    return document_split(df, key, fraction, seed) if key else row_split(df, None, fraction, seed)


def threshold_split(df: DataFrame, key: str, fraction: float = VAL_FRACTION, seed: int = SEED) -> DataFrame:
    """Label by hash threshold: one narrow pass that also works on streams; the share is approximate."""
    leading = F.conv(F.substring(split_rank(column(key), seed), 1, 8), 16, 10).cast("long")
    held_out = leading < F.lit(int(fraction * 2**32))
    return df.withColumn("split", F.when(held_out, F.lit("val")).otherwise(F.lit("train")))


def small_subset(df: DataFrame, *order_by: Column | str, rows: int = SMALL_ROWS) -> DataFrame:
    """The first rows in an order, for smoke runs (a bounded top-k)."""
    return df.orderBy(*order_by).limit(rows)


def split_outputs(labelled: DataFrame, *small_order: Column | str, rows: int = SMALL_ROWS) -> dict[str, DataFrame]:
    """The three data sets of a labelled frame: ``train_full``, ``val`` and ``train_small``."""
    train = labelled.filter(F.col("split") == "train").drop("split")
    return {
        "train_full": train,
        "val": labelled.filter(F.col("split") == "val").drop("split"),
        "train_small": small_subset(train, *small_order, rows=rows),
    }


def split_sizes(labelled: DataFrame, key: str) -> DataFrame:
    """Documents and rows per split."""
    document = F.coalesce(F.concat(F.lit("="), column(key).cast("string")), F.lit(""))
    return labelled.groupBy("split").agg(
        F.count_distinct(document).alias("documents"), F.count(F.lit(1)).alias("rows")
    )


def rows_with_key_in(df: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    """Rows whose key is among ``keys``; null matches null.

    The key set is made distinct first, so a key repeated there is collapsed before it moves; a key
    repeated on the left is what AQE splits. Spark broadcasts the set when its size allows.
    """
    right = keys.select(column(key).alias("__key")).distinct()
    return df.join(right, column(key).eqNullSafe(F.col("__key")), "left_semi")


def rows_with_key_not_in(df: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    """The complement of ``rows_with_key_in``."""
    right = keys.select(column(key).alias("__key")).distinct()
    return df.join(right, column(key).eqNullSafe(F.col("__key")), "left_anti")
