"""Preparation of raw corpora: derived clean columns, the empty-row filter and its counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from corpus_spark.functions.chat import chat_messages
from corpus_spark.functions.source_text import clean_source, clean_target
from corpus_spark.functions.text import has_text
from corpus_spark.operators.columns import SOURCE_ALIASES, TARGET_ALIASES, column, require_column
from corpus_spark.operators.split import auto_split

SOURCE_CLEAN = "transliteration_clean"
TARGET_CLEAN = "translation_clean"


def with_clean(df: DataFrame, **clean: Column) -> DataFrame:
    """Add clean columns and keep the rows where none of them is empty.

    The rows come out of a generator over zero or one struct. A plain filter on the new columns
    would be pushed below them, and every row would be cleaned twice, once to be tested.
    """
    row = F.array(F.struct(*[value.alias(name) for name, value in clean.items()]))

    def kept(fields: Column) -> Column:
        test = F.lit(True)
        for name in clean:
            test = test & (F.length(fields[name]) > 0)
        return test

    return df.select("*", F.inline(F.filter(row, kept)))


def clean_parallel(df: DataFrame, observation: Observation | None = None) -> DataFrame:
    """Add both clean columns and keep the rows where neither is empty.

    With an ``observation`` the counts ``rows_in``, ``rows_kept`` and ``rows_dropped`` are taken
    in the same pass as whatever job runs the frame.
    """
    source = column(require_column(df, *SOURCE_ALIASES))
    target = column(require_column(df, *TARGET_ALIASES))
    clean = {SOURCE_CLEAN: clean_source(source), TARGET_CLEAN: clean_target(target)}
    if observation is None:
        # A blank raw side cannot become text; dropping it here lets the null tests reach the scan.
        return with_clean(df.filter(has_text(source) & has_text(target)), **clean)
    kept = (F.length(SOURCE_CLEAN) > 0) & (F.length(TARGET_CLEAN) > 0)
    return df.withColumns(clean).observe(
        observation,
        F.count(F.lit(1)).alias("rows_in"),
        F.count_if(kept).alias("rows_kept"),
        F.count_if(~kept).alias("rows_dropped"),
    ).filter(kept)


def clean_test(df: DataFrame) -> DataFrame:
    """Add the clean source column; no row is dropped."""
    source = column(require_column(df, *SOURCE_ALIASES))
    return df.withColumn(SOURCE_CLEAN, clean_source(source))


def kept_counts(df: DataFrame, source: str, target: str, *by: str) -> DataFrame:
    """Rows in, kept and dropped by the empty-row filter, per group of already clean columns."""
    kept = (F.length(column(source)) > 0) & (F.length(column(target)) > 0)
    return df.groupBy(*by).agg(
        F.count(F.lit(1)).alias("rows_in"),
        F.count_if(kept).alias("rows_kept"),
        F.count_if(~kept).alias("rows_dropped"),
    )


def chat_sets(clean: DataFrame, *keep: str) -> DataFrame:
    """Clean parallel rows labelled ``train`` or ``val`` by document, as chat records in ``messages``.

    Rows with a missing side make no record. The named columns stay, for an order of the small set.
    """
    source = column(require_column(clean, SOURCE_CLEAN))
    target = column(require_column(clean, TARGET_CLEAN))
    labelled = auto_split(clean.filter(source.isNotNull() & target.isNotNull()))
    return labelled.select(*[column(name) for name in keep], chat_messages(source, target).alias("messages"), "split")
