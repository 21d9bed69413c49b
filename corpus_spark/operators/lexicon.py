"""Lexicon tables, and hints from them for the words of a text."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpus_spark.functions.text import words
from corpus_spark.operators.columns import column
from corpus_spark.session import scratch_path


def name_table(lexicon: DataFrame, form: str = "form", norm: str = "norm", kind: str = "type", kinds: tuple[str, ...] = ("PN", "GN", "DN")) -> DataFrame:
    """(form, norm): one normal form for each form of the given kinds, by the order of the kinds and then of the text."""
    rank = F.array_position(F.array(*map(F.lit, kinds)), column(kind))
    known = lexicon.filter(column(kind).isin(*kinds) & column(form).isNotNull() & column(norm).isNotNull())
    return known.groupBy(column(form).alias("form")).agg(F.min(F.struct(rank.alias("rank"), column(norm).alias("norm"))).alias("best")).select("form", "best.norm")


def meanings(lexicon: DataFrame, form: str = "form", meaning: str = "meaning") -> DataFrame:
    """(form, meanings): the distinct meanings of each form in order; null forms and meanings are left out."""
    known = lexicon.filter(column(form).isNotNull() & column(meaning).isNotNull()).select(column(form).alias("form"), column(meaning).alias("meaning"))
    return known.distinct().groupBy("form").agg(F.array_sort(F.collect_list("meaning")).alias("meanings"))


def first_places(texts: DataFrame, key: str, text: str = "text", among: DataFrame | None = None) -> DataFrame:
    """(key, word, place): each word of each text with its first place; with ``among``, a frame with a column ``form``, only those words.

    A row's words are made distinct within the row, where no other row's stand in memory, so what is shuffled is one
    row for each, of asked words only.
    """
    places = F.sort_array(F.transform(words(F.coalesce(column(text), F.lit(""))), lambda word, place: F.struct(word.alias("word"), place.alias("place"))))
    # A list of one, so that the places are computed once.
    first = F.get(F.transform(F.array(places), lambda own: F.filter(own, lambda each, at: (at == 0) | (F.get(own, at - 1)["word"] != each["word"]))), F.lit(0))
    found = texts.select(column(key).alias("key"), F.inline(first))
    if among is not None:
        found = found.join(among.select("form"), F.expr("word = form"), "left_semi")
    return found.repartition("key", "word").groupBy("key", "word").agg(F.min("place").alias("place"))


def _written(df: DataFrame, name: str) -> DataFrame:
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _told(
    texts: DataFrame, lexicon: DataFrame, key: str, text: str, form: str, meaning: str, max_share: float, min_meanings: int
) -> tuple[DataFrame, DataFrame]:
    """(key, word, place) of the words to tell, and (form, meanings) of each. Both are read twice and of a known size once written."""
    known, entries = texts.filter(column(key).isNotNull()), meanings(lexicon, form, meaning)
    limit = max_share * known.select(column(key)).distinct().count()
    found = _written(first_places(known, key, text, entries), "first-places")
    held = found.groupBy("word").agg(F.count(F.lit(1)).alias("texts")).join(entries, F.expr("word = form"))
    told = _written(held.filter((F.col("texts") <= limit) | (F.size("meanings") >= min_meanings)).select("form", "meanings"), "told")
    return found.join(told.select("form"), F.expr("word = form"), "left_semi"), told


def _by_text(chosen: DataFrame, told: DataFrame) -> DataFrame:
    """(key, hints). Meanings are joined where the words of a text have come together, so they are not shuffled with them."""
    joined = chosen.repartition("key").join(told, F.expr("word = form"))
    return joined.groupBy("key").agg(F.array_sort(F.collect_list(F.struct("place", "form", "meanings"))).alias("hints"))


def hints(
    texts: DataFrame, lexicon: DataFrame, key: str, text: str = "text", form: str = "form", meaning: str = "meaning",
    max_share: float = 0.01, min_meanings: int = 2,
) -> DataFrame:
    """(key, hints): for each text with any, (place, form, meanings) of its rare or ambiguous lexicon words, in text order.

    A word is rare where at most ``max_share`` of all texts hold it, ambiguous where the lexicon has ``min_meanings``
    or more for it. Each word is named once, at its first place. Keys tell texts apart; rows of one key are
    one text, and a null key is left out. Only words of the lexicon are counted, each text's once, so a word that every
    text has is one row per text, combined by word before the shuffle. Runs jobs to count the texts and to write
    the places of their words.
    """
    return _by_text(*_told(texts, lexicon, key, text, form, meaning, max_share, min_meanings)).withColumnRenamed("key", key)


def _lines(found: Column, meanings: Callable[[Column], Column]) -> Column:
    line = F.transform(found, lambda each: F.concat(F.lit("- "), each["form"], F.lit(": "), meanings(each["meanings"])))
    return F.when(F.coalesce(F.size(found), F.lit(0)) > 0, F.concat(F.lit("Lexicon hints:\n"), F.array_join(line, "\n"))).otherwise("")


def hint_lines(found: Column) -> Column:
    """``Lexicon hints:`` and a line for each; empty without any."""
    return _lines(found, lambda meanings: F.array_join(meanings, ", "))


def with_hints(
    texts: DataFrame, lexicon: DataFrame, key: str, text: str = "text", name: str = "hints", form: str = "form", meaning: str = "meaning",
    max_share: float = 0.01, min_meanings: int = 2,
) -> DataFrame:
    """The texts with their hints as lines, empty where there are none. A column already named so is replaced."""
    chosen, told = _told(texts, lexicon, key, text, form, meaning, max_share, min_meanings)
    # Meanings as the text that their line has, and lines as one text: what waits to be grouped and joined is smaller than lists.
    by_text = _by_text(chosen, told.select("form", F.array_join("meanings", ", ").alias("meanings")))
    lines = by_text.select(F.col("key").alias("of"), _lines(F.col("hints"), lambda meanings: meanings).alias("lines"))
    kept = [each for each in texts.columns if each.lower() != name.lower()]
    rows = texts.select(F.struct(*map(column, kept)).alias("row"), column(key).alias("key"))
    joined = rows.join(lines, F.expr("key = of"), "left")
    return joined.select(*[F.col("row").getField(each).alias(each) for each in kept], F.coalesce(F.col("lines"), F.lit("")).alias(name))
