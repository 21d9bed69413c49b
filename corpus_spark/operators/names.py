"""Names found in texts and replaced by their canonical forms."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpus_spark.operators.columns import column

# Letters and digits, and what stands between them.
TOKEN = r"[\p{L}\p{N}]+|[^\p{L}\p{N}]+"
CAPITALIZED = r"\p{Lu}[\p{L}\p{N}]*"


def tokens(text: Column) -> Column:
    """Words and the gaps between them, which together are the text."""
    return F.regexp_extract_all(text, F.lit(TOKEN), F.lit(0))


def capitalized(texts: DataFrame, text: str = "text") -> DataFrame:
    """(name, times): the words that begin with a capital letter, and how often they stand."""
    own = F.filter(tokens(F.coalesce(column(text), F.lit(""))), lambda token: token.rlike(rf"^{CAPITALIZED}$"))
    return texts.select(F.explode(own).alias("name")).groupBy("name").agg(F.count(F.lit(1)).alias("times"))


def _gram(values: Column, at: Column, size: int) -> Column:
    return F.concat(*[F.get(values, at + step) for step in range(size)])


def replace_names(
    texts: DataFrame, table: DataFrame, key: str, text: str = "text", name: str = "name", canonical: str = "canonical", max_tokens: int = 7,
) -> DataFrame:
    """The texts with every name of the table replaced, where it stands as whole words.

    Names are phrases of words and gaps, as they are written. Of names that begin at one place the longest is taken,
    and a place inside a name that was taken is no beginning: matches are taken from left to right. A
    replacement is not looked at again. Of two entries for a name the first in order counts; empty and
    null ones are left out, and names of more than ``max_tokens`` words and gaps are an error.

    All names are looked up at once: each text asks for its distinct phrases of the lengths that names have, by a join
    on the phrase, and keeps those that are names; then it is gone through once. Spark broadcasts the names
    while they are few. Keys tell texts apart; a row with a null key, and a null text, stay as they are. Runs a job for
    the lengths of the names.
    """
    listed = table.filter((F.coalesce(column(name), F.lit("")) != "") & column(canonical).isNotNull()).groupBy(column(name).alias("phrase")).agg(F.min(column(canonical)).alias("put"))
    sizes = sorted({row.size for row in listed.select(F.size(tokens(F.col("phrase"))).alias("size")).distinct().collect()})
    if not sizes:
        return texts
    if sizes[-1] > max_tokens:
        raise ValueError(f"a name has {sizes[-1]} words and gaps, more than {max_tokens}")
    parts = texts.filter(column(key).isNotNull() & column(text).isNotNull()).select(column(key).alias("of"), tokens(column(text)).alias("parts"))

    def phrases(values: Column) -> Column:
        places = F.sequence(F.lit(0), F.size(values) - 1)
        return F.array_distinct(F.flatten(F.array(*[F.filter(F.transform(places, lambda at: _gram(values, at, size)), lambda each: each.isNotNull()) for size in sizes])))

    asked = parts.filter(F.size("parts") > 0).select("of", F.explode(phrases(F.col("parts"))).alias("asked"))
    found = asked.join(listed, F.expr("asked = phrase")).groupBy(F.col("of").alias("found_of")).agg(F.collect_set(F.struct("phrase", "put")).alias("found"))
    joined = texts.select(F.struct(*map(column, texts.columns)).alias("row"), column(key).alias("of")).join(found, F.expr("of = found_of"), "left")
    value = F.col("row").getField(text)
    replaced = F.when(F.col("found").isNull() | value.isNull(), value).otherwise(_replaced(value, F.map_from_entries("found"), sizes))
    return joined.select(*[(replaced if each == text else F.col("row").getField(each)).alias(each) for each in texts.columns])


def _replaced(value: Column, found: Column, sizes: list[int]) -> Column:
    """The text gone through once with its own names."""
    def matches(one: Column) -> Column:
        places = F.sequence(F.lit(0), F.size(one["parts"]) - 1)
        longest = lambda at: F.coalesce(*[
            F.when(F.element_at(one["found"], _gram(one["parts"], at, size)).isNotNull(), F.struct(at.alias("start"), (at + size).alias("stop"), F.element_at(one["found"], _gram(one["parts"], at, size)).alias("put")))
            for size in reversed(sizes)
        ])
        every = F.filter(F.transform(places, longest), lambda each: each.isNotNull())
        none = F.filter(every, lambda each: F.lit(False))
        # Only matches are gone through, and they are few.
        return F.aggregate(every, none, lambda kept, each: F.when(
            (F.size(kept) == 0) | (F.element_at(kept, -1)["stop"] <= each["start"]), F.array_append(kept, each)
        ).otherwise(kept))

    def rebuilt(one: Column) -> Column:
        kept, parts = one["kept"], one["parts"]
        stretch = F.transform(kept, lambda each, at: F.concat(
            F.array_join(F.slice(parts, F.coalesce(F.get(kept, at - 1)["stop"], F.lit(0)) + 1, each["start"] - F.coalesce(F.get(kept, at - 1)["stop"], F.lit(0))), ""), each["put"],
        ))
        last = F.coalesce(F.get(kept, F.size(kept) - 1)["stop"], F.lit(0))
        return F.concat(F.array_join(stretch, ""), F.array_join(F.slice(parts, last + 1, F.size(parts)), ""))

    # Lists of one, so that each step is computed once.
    opened = F.array(F.struct(tokens(value).alias("parts"), found.alias("found")))
    with_matches = F.transform(opened, lambda one: F.struct(one["parts"].alias("parts"), matches(one).alias("kept")))
    return F.when(value == "", value).otherwise(F.get(F.transform(with_matches, rebuilt), F.lit(0)))
