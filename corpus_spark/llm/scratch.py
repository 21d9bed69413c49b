"""Tables written to the shared folder and read back, so that lost executors never recompute them differently."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpus_spark.session import scratch_path


def written(df: DataFrame, name: str, *partition_by: str) -> DataFrame:
    """The frame as a Parquet table below the folder that ``spark.checkpoint.dir`` names.

    Its lineage ends at the files. They stay until the cluster clears that folder.
    """
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.partitionBy(*partition_by).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def with_key(df: DataFrame, name: str) -> DataFrame:
    """The frame written with a number for each row: decisions about rows can be joined back on it, whatever
    their ids are. The numbers are facts once they are written."""
    return written(df.withColumn(name, F.monotonically_increasing_id()), "keyed-rows")
