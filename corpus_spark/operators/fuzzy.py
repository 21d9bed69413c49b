"""Forms matched to canonical forms by edit distance, without comparing all with all."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpus_spark.operators.columns import column

MAX_DISTANCE = 1
MIN_CHARS = 4


def _without_one(values: Column) -> Column:
    """Each text, and each with one character left out."""
    def shorter(value: Column) -> Column:
        gaps = F.transform(F.sequence(F.lit(1), F.length(value)), lambda at: F.concat(F.left(value, at - 1), F.substring(value, at + 1, F.length(value))))
        return F.when(F.length(value) > 0, F.array_append(gaps, value)).otherwise(F.array(value))

    return F.array_distinct(F.flatten(F.transform(values, shorter)))


def deletions(value: Column, max_distance: int) -> Column:
    """The distinct texts that up to ``max_distance`` left out characters make of a text, itself included."""
    found = F.array(value)
    for _ in range(max_distance):
        found = _without_one(found)
    return found


def fuzzy_pairs(
    forms: DataFrame, canonical: DataFrame, form: str = "form", canonical_form: str = "form", max_distance: int = MAX_DISTANCE, min_chars: int = MIN_CHARS,
) -> DataFrame:
    """(form, canonical, distance): all pairs of distinct texts within ``max_distance`` edits.

    Two texts within so many edits become equal when at most so many characters are left out of each, so they share
    a deletion and meet in its block; nothing is missed, and pairs that only share a block are dropped by
    their Levenshtein distance. Texts of fewer than ``min_chars`` characters match nothing but themselves, because all
    short texts are near each other. What is left bounds a block by the alphabet: the distinct texts from which one
    deletion gives the same rest are as many as it has places times letters, however many texts there are. Null forms
    match nothing. Short equal texts are pairs too, of distance 0.
    """
    left = forms.filter(column(form).isNotNull()).select(column(form).alias("form")).distinct()
    right = canonical.filter(column(canonical_form).isNotNull()).select(column(canonical_form).alias("canonical")).distinct()

    def blocks(df: DataFrame, name: str, block: str) -> DataFrame:
        own = F.when(F.length(name) >= min_chars, deletions(F.col(name), max_distance)).otherwise(F.array(F.col(name)))
        return df.select(name, F.explode(own).alias(block))

    met = blocks(left, "form", "block").join(blocks(right, "canonical", "of_block"), F.expr("block = of_block")).select("form", "canonical")
    far = met.filter((F.col("form") == F.col("canonical")) | ((F.length("form") >= min_chars) & (F.length("canonical") >= min_chars)))
    near = far.withColumn("distance", F.levenshtein("form", "canonical", max_distance)).filter("distance >= 0")
    return near.distinct()


def fuzzy_table(
    forms: DataFrame, canonical: DataFrame, form: str = "form", canonical_form: str = "form", max_distance: int = MAX_DISTANCE, min_chars: int = MIN_CHARS,
) -> DataFrame:
    """(form, canonical, distance): the nearest canonical form of each form, where it has one and no other is as near."""
    pairs = fuzzy_pairs(forms, canonical, form, canonical_form, max_distance, min_chars)
    nearest = pairs.groupBy("form").agg(F.min(F.struct("distance", "canonical")).alias("least"), F.max(F.struct(-F.col("distance"), "canonical")).alias("last"))
    return nearest.filter("least.canonical = last.canonical").select("form", "least.canonical", "least.distance")
