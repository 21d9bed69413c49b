"""The driver's tables seen as corpus tables.

The tables hold clean prose, so scribal marks, template tokens and repeats are put in by plain
string expressions over whole texts; the SQL side writes the same expressions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


# Marks put into the prose: (found, put in its place).
SOURCE_MARKS = (
    (" of ", " [of] / "),
    (" in ", " <in> [x x] : "),
    (". ", "! <<gone>> [... ...] ḫ₄˹a˺² "),
    (", ", "? [...] "),
    ("é", "é"),
)
LINE_LABELS = ("1. ", "r. 2'. ", "obv 3 ", " 4. ", "rev. 12′. ")
OUTPUT_MARKS = (
    (" the ", " the <|im_end|>"),
    (".\n", "<think>\nhm </think>.\n"),
    (" and ", " and on and on and on and on "),
)


def replace_all(text: Column, marks: tuple[tuple[str, str], ...]) -> Column:
    for found, put in marks:
        text = F.replace(text, F.lit(found), F.lit(put))
    return text


def marked_source(text: Column, key: Column) -> Column:
    """Prose turned into a damaged transliteration."""
    label = F.lit("")
    for place, value in enumerate(LINE_LABELS):
        label = F.when(key % (len(LINE_LABELS) + 1) == place, value).otherwise(label)
    return F.concat(label, replace_all(text, SOURCE_MARKS))


def marked_output(text: Column) -> Column:
    """Prose turned into raw model output."""
    return replace_all(text, OUTPUT_MARKS)


def some_blank(text: Column, size: Column) -> Column:
    """Every eleventh value becomes blank, every thirteenth missing."""
    return F.when(size % 11 == 0, F.lit(" \t")).when(size % 13 != 0, text)


# Tasks that rows of text tables are dealt to, or None to take the files' splits as they come. A table
# of one row group is one task; who runs on such a table (the bench) may set a number.
DEAL: int | None = None


def dealt(df: DataFrame) -> DataFrame:
    return df if DEAL is None else df.repartition(DEAL)


def texts(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A table whose text columns are about to be worked on."""
    return dealt(table(spark, folder, name))


def documents(spark: SparkSession, folder: str) -> DataFrame:
    return texts(spark, folder, "documents")


def conversations(spark: SparkSession, folder: str) -> DataFrame:
    return texts(spark, folder, "conversations")


def turn_pairs(spark: SparkSession, folder: str) -> DataFrame:
    """Each user turn with the assistant turn after it. The join key is the turn, not the
    conversation, so a long conversation spreads over the partitions."""
    turns = table(spark, folder, "conversations")
    asked = turns.filter("role = 'user'").select("conv_id", "turn", F.col("text").alias("source"))
    answered = turns.filter("role = 'assistant'").select(
        "conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("target")
    )
    return dealt(asked).join(answered, ["conv_id", "turn"])


def predictions(spark: SparkSession, folder: str) -> DataFrame:
    """Turn pairs as a predictions table: the question is scored against the answer."""
    return turn_pairs(spark, folder).select(
        "conv_id", "turn", F.col("source").alias("prediction"), F.col("target").alias("reference")
    )


def run_predictions(spark: SparkSession, folder: str) -> DataFrame:
    """The predictions dealt to four runs and four epochs."""
    return predictions(spark, folder).withColumns(
        {
            "run": F.concat(F.lit("model_r"), F.pow(F.lit(2), F.col("conv_id") % 4 + 3).cast("int"), F.lit("-a32_lr1e-4_ep4")),
            "epoch": F.floor(F.col("turn") / 2).cast("int"),
        }
    )
