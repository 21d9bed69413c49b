"""Training runs: names, settings, scores and ranking."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpus_spark.operators.columns import column

# Defaults and layout of run names.
DEFAULT_RANK, DEFAULT_ALPHA, DEFAULT_LR, DEFAULT_EPOCHS = "32", "64", "0.0002", "3"
RUN_NAME_PATTERN = r"\A(.*)_r([^-_]+)-a([^_]+)_lr([^_]+)_ep([^_]+)\z"


def model_tag(model_name: Column) -> Column:
    """Last path part, without an ``-Instruct`` tail, in lower case."""
    return F.lower(F.regexp_replace(F.substring_index(model_name, "/", -1), "(?s)-Instruct.*", ""))


def run_name(
    model_name: Column, rank: Column | None = None, alpha: Column | None = None,
    lr: Column | None = None, epochs: Column | None = None,
) -> Column:
    """``<model>_r<rank>-a<alpha>_lr<lr>_ep<epochs>``, with defaults for what is missing or null.

    Hand in a learning rate as it is written in the settings file, as text: ``2e-4`` stays ``2e-4``.
    """

    def part(label: str, value: Column | None, default: str) -> list[Column]:
        known = F.lit(default) if value is None else F.coalesce(value.cast("string"), F.lit(default))
        return [F.lit(label), known]

    return F.concat(
        model_tag(model_name),
        *part("_r", rank, DEFAULT_RANK),
        *part("-a", alpha, DEFAULT_ALPHA),
        *part("_lr", lr, DEFAULT_LR),
        *part("_ep", epochs, DEFAULT_EPOCHS),
    )


def identified(settings: DataFrame) -> DataFrame:
    """Settings with ``run`` and ``folder``: a name that is set wins over the built one, and a sweep
    puts its runs below its folder, each under its name."""
    built = run_name(*[column(name) for name in ("model_name", "lora_r", "lora_alpha", "lr", "epochs")])
    run = F.coalesce(column("run_name"), built)
    below = F.concat(F.regexp_replace(column("sweep_dir"), "/+\\z", ""), F.lit("/"), run)
    return settings.withColumns({"run": run, "folder": F.coalesce(below, column("output_dir"))})


def parse_run_name(df: DataFrame, run: str = "run") -> DataFrame:
    """Add ``model``, ``lora_r``, ``lora_alpha``, ``lr`` and ``epochs``; null where the name has another form."""

    def field(group: int) -> Column:
        return F.nullif(F.regexp_extract(run, RUN_NAME_PATTERN, group), F.lit(""))

    return df.withColumns(
        {
            "model": field(1),
            "lora_r": field(2).try_cast("int"),
            "lora_alpha": field(3).try_cast("int"),
            "lr": field(4).try_cast("double"),
            "epochs": field(5).try_cast("int"),
        }
    )


def with_settings(scores: DataFrame, settings: DataFrame, run: str = "run") -> DataFrame:
    """Scores with their run's settings; a run without settings keeps its scores."""
    return scores.join(settings, run, "left")


def best_run(scores: DataFrame, *per: str, metric: str = "geomean", run: str = "run") -> DataFrame:
    """The row of the best run, per group: highest metric, equal ones by the greater run name."""
    others = [name for name in scores.columns if name not in per]
    best = F.max_by(F.struct(*others), F.struct(F.col(metric), F.col(run))).alias("best")
    return scores.groupBy(*per).agg(best).select(*per, "best.*")


def rank_runs(scores: DataFrame, *per: str, metric: str = "geomean", run: str = "run") -> DataFrame:
    """All runs with their ``place`` per group, best first. One row per run goes in."""
    window = Window.partitionBy(*per).orderBy(F.desc(metric), F.desc(run))
    return scores.withColumn("place", F.row_number().over(window))
