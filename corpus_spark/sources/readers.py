"""Readers. CSV columns come as text; types are cast where they are used."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpus_spark.functions.chat import CHAT_SCHEMA
from corpus_spark.operators.columns import column
from corpus_spark.operators.indexing import POSITION

# The null token is one no text holds, so a quoted empty field stays an empty text and only an
# unquoted one is null.
# A file whose header differs from the first one's is an error, not columns by position.
_CSV = {"header": "true", "quote": '"', "escape": '"', "encoding": "UTF-8", "nullValue": "\u0000", "enforceSchema": "false"}

# The keys of a run's settings file.
SETTINGS_KEYS = (
    "model_name", "max_seq_length", "load_in_4bit", "train_data", "val_data", "output_dir", "sweep_dir",
    "batch_size", "eval_batch_size", "grad_accum", "epochs", "lr", "lora_r", "lora_alpha", "run_name",
    "report_to", "inference_batch_size", "max_new_tokens",
)


def read_csv(
    spark: SparkSession, *paths: str, na_tokens: tuple[str, ...] = (), line_breaks: bool = True, positions: bool = False
) -> DataFrame:
    """CSV with a header, RFC 4180 quotes and line breaks in fields. All files have one header.

    Only an empty unquoted field is null; ``na_tokens`` names further values to read as null. A file
    with line breaks in fields cannot be split, so each is one task (``write_csv`` bounds the size of
    its parts); where no field holds one, say so with ``line_breaks=False`` and files are split.
    ``positions`` adds a column that says where in which file a row stood, for ``with_row_index`` and
    keyless splits; files count by path, whatever the order they are named in.
    """
    df = spark.read.options(**_CSV, multiLine=line_breaks).csv(list(paths))
    if na_tokens:
        df = df.select(*[F.when(~column(name).isin(*na_tokens), column(name)).alias(name) for name in df.columns])
    if not positions:
        return df
    # Within a split of a file the running number follows the rows; splits follow by their start.
    place = F.struct(F.col("_metadata.file_path"), F.col("_metadata.file_block_start"), F.monotonically_increasing_id().alias("row"))
    return df.withColumn(POSITION, place)


def read_chat(spark: SparkSession, *paths: str) -> DataFrame:
    """JSON lines of chat records."""
    return spark.read.schema(CHAT_SCHEMA).json(list(paths))


def read_parquet(spark: SparkSession, *paths: str) -> DataFrame:
    return spark.read.parquet(*paths)


def read_scores(spark: SparkSession, folder: str) -> DataFrame:
    """Score documents of all runs under ``<folder>/<run>/scores.json``, with the run name from the path."""
    schema = "bleu double, chrfpp double, geomean double, epoch int"
    found = spark.read.schema(schema).option("multiLine", "true").json(f"{folder.rstrip('/')}/*/scores.json")
    path = F.col("_metadata.file_path")
    run = F.url_decode(F.regexp_extract(F.replace(path, F.lit("+"), F.lit("%2B")), r"([^/]+)/scores\.json(?:/[^/]*)?\z", 1))
    return found.select(run.alias("run"), "bleu", "chrfpp", "geomean", "epoch")


def read_settings(spark: SparkSession, *paths: str) -> DataFrame:
    """Flat ``key: value`` settings files, one row per file, one text column per known key."""
    line = F.col("value")
    pairs = spark.read.text(list(paths)).select(
        F.col("_metadata.file_path").alias("file"),
        F.regexp_extract(line, r"\A(\w+):", 1).alias("key"),
        F.regexp_replace(F.regexp_extract(line, r"\A\w+:\s*(.*?)\s*(?:#.*)?\z", 1), r"\A([\"'])(.*)\1\z", "$2").alias("setting"),
    )
    return pairs.groupBy("file").pivot("key", list(SETTINGS_KEYS)).agg(F.first("setting"))


def read_run_scores(spark: SparkSession, folder: str) -> DataFrame:
    """What ``write_run_scores`` wrote; the run name comes from the folder."""
    return spark.read.schema("bleu double, chrfpp double, geomean double, epoch int, run string").json(folder)
