"""Writers. Each makes a folder of part files; parent folders are made as needed."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpus_spark.operators.columns import column
from corpus_spark.operators.split import SMALL_ROWS, split_outputs

_CSV = {
    "header": "true", "quote": '"', "escape": '"', "encoding": "UTF-8",
    "ignoreLeadingWhiteSpace": "false", "ignoreTrailingWhiteSpace": "false",
}
# A part with line breaks in fields is one task when it is read back, so parts are bounded in bytes.
CSV_BYTES_PER_FILE = 128 << 20


def rows_per_file(df: DataFrame, most_bytes: int = CSV_BYTES_PER_FILE) -> int:
    """Rows that make about ``most_bytes``, from the mean size of all rows (one pass over them)."""
    size = F.lit(len(df.columns))
    for name in df.columns:
        size = size + F.coalesce(F.octet_length(column(name).cast("string")), F.lit(0))
    mean = df.agg(F.avg(size)).first()[0]
    return max(1, int(most_bytes / mean)) if mean else 0


def write_csv(df: DataFrame, path: str, bytes_per_file: int | None = CSV_BYTES_PER_FILE) -> None:
    """CSV parts of about ``bytes_per_file`` whatever the rows' size; None leaves parts as tasks make them."""
    most = rows_per_file(df, bytes_per_file) if bytes_per_file else 0
    df.write.mode("overwrite").options(**_CSV).option("maxRecordsPerFile", most).csv(path)


def write_jsonl(df: DataFrame, path: str) -> None:
    """JSON lines, UTF-8 as it is, null fields written."""
    df.write.mode("overwrite").option("ignoreNullFields", "false").json(path)


def write_split(labelled: DataFrame, path: str) -> None:
    """A labelled frame as Parquet with one folder per split, so readers prune to theirs."""
    labelled.write.mode("overwrite").partitionBy("split").parquet(path)


def write_chat_sets(labelled: DataFrame, folder: str, *small_order: str, rows: int = SMALL_ROWS) -> None:
    """The chat sets ``train_full.jsonl``, ``val.jsonl`` and ``train_small.jsonl`` of a labelled frame with ``messages``.

    The frame is labelled and written once, by split; the sets are read from there, so three writes
    do not find the cutoff three times. The small set is the first ``rows`` in the given order.
    """
    staged = f"{folder.rstrip('/')}/labelled"
    write_split(labelled, staged)
    parts = split_outputs(labelled.sparkSession.read.parquet(staged), *[column(name) for name in small_order], rows=rows)
    for name, part in parts.items():
        write_jsonl(part.select("messages"), f"{folder.rstrip('/')}/{name}.jsonl")


def write_predictions(df: DataFrame, path: str, *layout: str) -> None:
    """Predictions as Parquet under ``column=value`` folders, such as split, variant and stage."""
    df.write.mode("overwrite").partitionBy(*layout).parquet(path)


def write_scores(scores: DataFrame, path: str) -> None:
    """One score row as a JSON document."""
    scores.coalesce(1).write.mode("overwrite").json(path)


def write_submission(submission: DataFrame, path: str, order_by: str | None = None, single_file: bool = False) -> None:
    """``id, translation`` as CSV. ``single_file`` is for readers that take exactly one file; it
    sends every row through one task, so it is off unless asked for."""
    rows = submission.select("id", "translation")
    if order_by is not None:
        rows = rows.orderBy(column(order_by))
    if single_file:
        rows = rows.coalesce(1)
    write_csv(rows, path, None if single_file else CSV_BYTES_PER_FILE)


def write_run_scores(scores: DataFrame, folder: str) -> None:
    """Scores of many runs, one ``run=<name>`` folder each."""
    scores.write.mode("overwrite").partitionBy("run").json(folder)
