"""Scores of prediction tables: BLEU, chrF++ and their geometric mean, whole or per group."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpus_spark.functions.bleu import MAX_ORDER, bleu_counts, bleu_score
from corpus_spark.functions.chrf import CHAR_ORDER, WORD_ORDER, chrf_char_counts, chrf_score, chrf_word_counts
from corpus_spark.functions.generation import EMPTY_PREDICTION
from corpus_spark.operators.columns import PREDICTION_ALIASES, column, require_column

_FAMILIES = (("word", MAX_ORDER), ("chr", CHAR_ORDER), ("chw", WORD_ORDER))


def row_counts(df: DataFrame, hyp: str, ref: str, metrics: tuple[str, ...] = ("bleu", "chrf")) -> DataFrame:
    """Add the count arrays of the asked metrics to each row. Narrow: no shuffle, one Python hop."""
    added = {}
    if "bleu" in metrics:
        added["__word"] = bleu_counts(column(hyp), column(ref))
    if "chrf" in metrics:
        added["__chr"] = chrf_char_counts(column(hyp), column(ref))
        added["__chw"] = chrf_word_counts(column(hyp), column(ref))
    return df.withColumns(added)


def row_statistics(df: DataFrame, hyp: str, ref: str, metrics: tuple[str, ...] = ("bleu", "chrf")) -> DataFrame:
    """The counts as plain columns, named family, order, field: ``word1_hyp`` ... ``chw2_match``."""
    counted = row_counts(df, hyp, ref, metrics)
    cells = []
    for family, orders in _FAMILIES:
        if f"__{family}" not in counted.columns:
            continue
        for order in range(orders):
            n_hyp, n_ref, n_match = (f"get(__{family}, {3 * order + field})" for field in range(3))
            if family != "word":
                # An order the reference has no n-gram of does not count against the prediction.
                n_hyp = f"IF({n_ref} > 0, {n_hyp}, 0L)"
            name = f"{family}{order + 1}"
            cells += [f"{n_hyp} AS {name}_hyp", f"{n_ref} AS {name}_ref", f"{n_match} AS {name}_match"]
    return counted.selectExpr(*[f"`{name}`" for name in df.columns], *cells)


def corpus_statistics(
    df: DataFrame, hyp: str, ref: str, *by: str, metrics: tuple[str, ...] = ("bleu", "chrf")
) -> DataFrame:
    """Row statistics summed per group; sums combine on the map side, so a hot group costs one row per task."""
    kept = [column(name) for name in dict.fromkeys([*by, hyp, ref])]
    rows = row_statistics(df.select(*kept), hyp, ref, metrics)
    sums = [name for name in rows.columns if name not in {*by, hyp, ref}]
    return rows.groupBy(*by).agg(*[F.expr(f"coalesce(sum({name}), 0L) AS {name}") for name in sums])


def _series(family: str, orders: int, field: str) -> list[str]:
    return [f"{family}{order + 1}_{field}" for order in range(orders)]


def summed_bleu() -> Column:
    """BLEU from the summed columns of ``corpus_statistics``."""
    total, correct = _series("word", MAX_ORDER, "hyp"), _series("word", MAX_ORDER, "match")
    return bleu_score(total, correct, "word1_hyp", "word1_ref")


def summed_chrf() -> Column:
    """chrF++ from the summed columns of ``corpus_statistics``."""
    series = [
        _series("chr", CHAR_ORDER, field) + _series("chw", WORD_ORDER, field) for field in ("hyp", "ref", "match")
    ]
    return chrf_score(*series)


def geometric_mean(bleu: Column, chrf: Column) -> Column:
    """Square root of the product; 0 when either score is not positive."""
    return F.when((bleu > 0) & (chrf > 0), F.sqrt(bleu * chrf)).otherwise(F.lit(0.0))


def score(df: DataFrame, hyp: str, ref: str, *by: str) -> DataFrame:
    """``bleu``, ``chrfpp`` and ``geomean`` of predictions against references, per group of ``by``."""
    statistics = corpus_statistics(df, hyp, ref, *by)
    scored = statistics.select(*by, summed_bleu().alias("bleu"), summed_chrf().alias("chrfpp"))
    return scored.withColumn("geomean", geometric_mean(F.col("bleu"), F.col("chrfpp")))


def evaluate(df: DataFrame, *by: str) -> DataFrame:
    """Score a predictions table: the clean prediction where there is one, nulls filled."""
    prediction = require_column(df, *PREDICTION_ALIASES)
    reference = require_column(df, "reference")
    filled = df.select(
        *by,
        F.coalesce(column(prediction), F.lit(EMPTY_PREDICTION)).alias("__prediction"),
        F.coalesce(column(reference), F.lit("")).alias("__reference"),
    )
    return score(filled, "__prediction", "__reference", *by)


def last_epoch_scores(scores: DataFrame, run: str = "run", epoch: str = "epoch") -> DataFrame:
    """Each run's scores at its last epoch."""
    kept = ("bleu", "chrfpp", "geomean", epoch)
    last = F.max_by(F.struct(*kept), column(epoch)).alias("last")
    return scores.groupBy(run).agg(last).select(run, "last.*")
