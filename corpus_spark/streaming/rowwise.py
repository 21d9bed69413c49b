"""Row-wise work on streams. The column functions hold no state, so a streaming frame takes them
as a batch frame does; this module only wires them to a file stream."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from corpus_spark.operators.corpus import clean_parallel
from corpus_spark.operators.split import VAL_FRACTION, threshold_split


def prepare_stream(raw: DataFrame, key: str, fraction: float = VAL_FRACTION) -> DataFrame:
    """Clean parallel rows as they arrive and label them by hash threshold."""
    return threshold_split(clean_parallel(raw), key, fraction)


def write_stream(prepared: DataFrame, path: str, checkpoint: str, once: bool = False) -> StreamingQuery:
    """Append to Parquet, one folder per split; ``once`` takes what is there and stops."""
    writer = prepared.writeStream.format("parquet").partitionBy("split").option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start(path)
