"""Submissions: an id and a translation per test row."""

from __future__ import annotations

import warnings

from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F

from corpus_spark.functions.generation import EMPTY_PREDICTION, postprocess
from corpus_spark.operators.columns import PREDICTION_ALIASES, SUBMISSION_ID_ALIASES, column, find_column, require_column
from corpus_spark.operators.indexing import POSITION, with_row_index


def _prediction(predictions: DataFrame) -> Column:
    return column(require_column(predictions, *PREDICTION_ALIASES))


def _translation(value: Column, apply_postprocess: bool) -> Column:
    return postprocess(value) if apply_postprocess else value


def with_submission_id(test: DataFrame) -> DataFrame:
    """The test table with its ``id``: the id column, else the text id, else the row position."""
    name = find_column(test, *SUBMISSION_ID_ALIASES)
    if name is None:
        warnings.warn(f"No id column among {test.columns}: the row position is the id", stacklevel=2)
        return with_row_index(test, name="id")
    return test if name == "id" else test.withColumn("id", column(name))


def submission(predictions: DataFrame, apply_postprocess: bool = True) -> DataFrame:
    """From predictions that carry their id: a projection, nothing is joined."""
    ids = column(require_column(predictions, *SUBMISSION_ID_ALIASES))
    return predictions.select(ids.alias("id"), _translation(_prediction(predictions), apply_postprocess).alias("translation"))


def submission_by_key(
    test: DataFrame, predictions: DataFrame, apply_postprocess: bool = True, observation: Observation | None = None
) -> DataFrame:
    """Every test id with its prediction, ``...`` where nothing was predicted.

    An id with two predictions is an error where a test row asks for it: predictions are counted per id on the
    partitioning and order that the join uses anyway, so there is one shuffle of each side. Texts are joined as
    they are and cleaned afterwards, so predictions no test row asks for are not cleaned. ``observation`` gets ``test_rows`` and ``predicted``, counted while writing.
    """
    ids = with_submission_id(test).select("id")
    found = predictions.select(
        column(require_column(predictions, *SUBMISSION_ID_ALIASES)).alias("id"), _prediction(predictions).alias("__text")
    )
    several = F.raise_error(F.concat(F.lit("Several predictions for id "), F.col("id").cast("string")))
    counted = found.withColumn("__n", F.count(F.lit(1)).over(Window.partitionBy("id")))
    joined = ids.join(counted, "id", "left")
    single = joined.withColumn("__n", F.when(F.col("__n") > 1, several.cast("long")).otherwise(F.col("__n")))
    return _filled(single, F.col("__n").isNotNull(), apply_postprocess, observation)


def _filled(joined: DataFrame, found: Column, apply_postprocess: bool, observation: Observation | None) -> DataFrame:
    if observation is not None:
        joined = joined.observe(observation, F.count(F.lit(1)).alias("test_rows"), F.count_if(found).alias("predicted"))
    text = F.when(found, F.col("__text")).otherwise(F.lit(EMPTY_PREDICTION))
    return joined.select("id", _translation(text, apply_postprocess).alias("translation"))


def submission_by_position(
    test: DataFrame,
    predictions: DataFrame,
    apply_postprocess: bool = True,
    test_order: tuple = (),
    prediction_order: tuple = (),
) -> DataFrame:
    """Pair the n-th test row with the n-th prediction, for prediction files without ids.

    Every test row comes out, with ``...`` where the predictions end before it; different counts are
    warned of. Positions follow the order columns, or else the order of the rows in their files.
    Only ids, texts and order columns are staged. Runs jobs when called.
    """
    named = with_submission_id(test)
    keep = [column("id"), *([F.col(POSITION)] if POSITION in named.columns else [])]
    ids = with_row_index(named.select(*keep, *test_order) if test_order else named.select(*keep), *test_order, name="__row")
    keep = [_prediction(predictions).alias("__text"), *([F.col(POSITION)] if POSITION in predictions.columns else [])]
    texts = with_row_index(
        predictions.select(*keep, *prediction_order) if prediction_order else predictions.select(*keep), *prediction_order, name="__row"
    ).select("__row", "__text", F.lit(True).alias("__found"))
    counts = position_counts(ids, texts).first()
    if not counts.same:
        warnings.warn(f"{counts.prediction_rows} predictions for {counts.test_rows} test rows", stacklevel=2)
    joined = ids.select("__row", "id").join(texts, "__row", "left")
    return _filled(joined, F.col("__found").isNotNull(), apply_postprocess, None)


def position_counts(test: DataFrame, predictions: DataFrame) -> DataFrame:
    """Rows on both sides and whether they agree."""
    sides = test.select(F.lit(1).alias("t"), F.lit(0).alias("p")).unionAll(
        predictions.select(F.lit(0).alias("t"), F.lit(1).alias("p"))
    )
    return sides.agg(
        F.coalesce(F.sum("t"), F.lit(0)).alias("test_rows"), F.coalesce(F.sum("p"), F.lit(0)).alias("prediction_rows")
    ).withColumn("same", F.col("test_rows") == F.col("prediction_rows"))


def observed(df: DataFrame, observation: Observation) -> DataFrame:
    """Count the rows of a frame, as ``rows``, in the pass that writes it."""
    return df.observe(observation, F.count(F.lit(1)).alias("rows"))
