"""The candidate that agrees most with its siblings, among several translations of one source."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpus_spark.functions.chrf import CHAR_ORDER, WORD_ORDER, chrf_score, split_punctuation
from corpus_spark.functions.ngrams import char_ngram_counts, word_ngram_counts
from corpus_spark.functions.text import drop_blanks
from corpus_spark.operators.columns import column

# Candidates of a source that meet those of another block in one row.
BLOCK = 32


def pool(name: str = "origin", **candidates: DataFrame) -> DataFrame:
    """Candidates of several models or seeds as one table, with a column that says whose they are."""
    named = [df.withColumn(name, F.lit(origin)) for origin, df in candidates.items()]
    return reduce(lambda a, b: a.unionByName(b), named)


def _pairs(candidates: DataFrame, block: int) -> DataFrame:
    """Each two candidates of a source once: (source, a, b), structs of candidate, chars and tokens.

    A source with many candidates has them dealt to blocks by hash, and its blocks meet two by two, each two in a row
    of their own; so the candidates of a source are never one row or one task.
    """
    sizes = candidates.groupBy("source").agg(F.ceil(F.count(F.lit(1)) / block).cast("int").alias("blocks"))
    sized = candidates.join(sizes.withColumnRenamed("source", "of"), F.expr("source <=> of")).drop("of")
    dealt = sized.withColumn("block", F.pmod(F.xxhash64("candidate"), "blocks").cast("int"))
    blocks = dealt.groupBy("source", "block", "blocks").agg(F.collect_list(F.struct("candidate", "chars", "tokens")).alias("members"))
    left = blocks.select("source", F.col("block").alias("block_a"), F.col("members").alias("a"), F.explode(F.sequence(F.col("block"), F.col("blocks") - 1)).alias("block_b"))
    right = blocks.select(F.col("source").alias("of"), F.col("block").alias("of_block"), F.col("members").alias("b"))
    met = left.join(right, F.expr("source <=> of AND block_b = of_block"))
    single = met.select("source", "block_a", "block_b", F.explode("a").alias("a"), "b").select("source", "block_a", "block_b", "a", F.explode("b").alias("b"))
    return single.filter("block_a <> block_b OR a.candidate < b.candidate").select("source", "a", "b")


def _counts(values: Column, orders: int, letter: str) -> dict[str, Column]:
    fields = ("hyp", "ref", "match")
    return {f"{letter}_{field}_{order}": F.get(values, F.lit(3 * order + place)) for order in range(orders) for place, field in enumerate(fields)}


def agreement(candidates: DataFrame, source: str, candidate: str, text: str = "text", block: int = BLOCK) -> DataFrame:
    """(source, candidate, agreement): the mean chrF++ of each candidate as a translation, its siblings being the references.

    Texts are prepared once for all their pairs, and the clipped n-gram counts of two texts give both directions.
    A single candidate has no mean (null). Candidates of a source are told apart by ``candidate``, which must not be null;
    null texts are empty ones, null sources are one source. Means are rounded to nine digits.
    """
    own = candidates.select(
        column(source).alias("source"), column(candidate).alias("candidate"), drop_blanks(F.coalesce(column(text), F.lit(""))).alias("chars"),
        split_punctuation(column(text)).alias("tokens"),
    )
    counted = _pairs(own, block).withColumns({
        "c": char_ngram_counts(F.col("a.chars"), F.col("b.chars"), CHAR_ORDER), "w": word_ngram_counts(F.col("a.tokens"), F.col("b.tokens"), WORD_ORDER),
    }).select("source", F.col("a.candidate").alias("a"), F.col("b.candidate").alias("b"), "c", "w")
    named = {**_counts(F.col("c"), CHAR_ORDER, "c"), **_counts(F.col("w"), WORD_ORDER, "w")}
    flat = counted.select("source", "a", "b", *[value.alias(name) for name, value in named.items()])
    hyp, ref, match = ([name for name in named if f"_{field}_" in name] for field in ("hyp", "ref", "match"))
    both = flat.select("source", F.explode(F.array(
        F.struct(F.col("a").alias("candidate"), chrf_score(hyp, ref, match).alias("score")),
        F.struct(F.col("b").alias("candidate"), chrf_score(ref, hyp, match).alias("score")),
    )).alias("each")).select("source", "each.*")
    means = both.groupBy("source", "candidate").agg(F.round(F.avg("score"), 9).alias("agreement"))
    every = own.select(F.col("source").alias("s"), F.col("candidate").alias("k"))
    joined = every.join(means, F.expr("s <=> source AND k = candidate"), "left")
    return joined.select(F.col("s").alias(source), F.col("k").alias(candidate), "agreement")


def choose(candidates: DataFrame, source: str, candidate: str, text: str = "text", block: int = BLOCK) -> DataFrame:
    """(source, candidate, agreement): the candidate of each source with the highest agreement, ties to the smallest."""
    scored = agreement(candidates, source, candidate, text, block)
    best = F.min(F.struct(F.negate(F.coalesce("agreement", F.lit(0.0))).alias("rank"), column(candidate).alias("candidate"), "agreement"))
    return scored.groupBy(column(source)).agg(best.alias("best")).select(column(source), F.col("best.candidate").alias(candidate), "best.agreement")
