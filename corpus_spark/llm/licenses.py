"""Licence notices in texts, found by their rarest words. DataFrame functions only.

A template is a notice as a list of words. The index holds, for each template, its words of highest
inverse document frequency with their places in it. Where a text has such a word, the place less the
word's place in the template is where the notice would start; starts that several words point at are
one. There the template is laid over the text: its words count by their inverse document frequency
where they stand at their relative place, and the template's key phrase must stand in full.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpus_spark.llm.names import all_but, fresh, quoted

# Words are runs of ASCII letters and digits and of all other characters.
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
# Of each template's words, how many of the rarest are in the index.
RARE_WORDS = 2
# Share of a template's weight that must stand in place.
MIN_SHARE = 0.8


@dataclass(frozen=True)
class Template:
    label: str
    words: str
    key: str
    base: bool = False


# The phrases and labels asked for, then short notices as licences word them.
BASE = (
    Template("gpl", "gnu general public license", "gnu general public license", True),
    Template("apache", "apache license", "apache license", True),
    Template("cc-by", "cc by", "cc by", True),
    Template("mit", "mit license", "mit license", True),
)
NOTICES = (
    Template("apache-2.0", "licensed under the apache license version 2 0", "apache license version 2 0"),
    Template("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software", "permission is hereby granted free of charge"),
    Template("bsd", "redistribution and use in source and binary forms with or without modification are permitted", "source and binary forms"),
    Template("cc-by-nc", "licensed under cc by nc", "cc by nc"),
    Template("cc-by-sa", "licensed under cc by sa", "cc by sa"),
    Template("cc-by-nd", "licensed under cc by nd", "cc by nd"),
    Template("gpl", "under the terms of the gnu general public license", "gnu general public license"),
    Template("lgpl", "gnu lesser general public license", "gnu lesser general public license"),
    Template("agpl", "gnu affero general public license", "gnu affero general public license"),
    Template("mpl", "mozilla public license", "mozilla public license"),
    Template("isc", "permission to use copy modify and or distribute this software for any purpose", "permission to use copy modify"),
    Template("unlicense", "this is free and unencumbered software released into the public domain", "free and unencumbered software"),
)
TEMPLATES = BASE + NOTICES


def words(text: Column) -> Column:
    """Words with A-Z in lower case; none for null."""
    lowered = F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER)
    return F.regexp_extract_all(lowered, F.lit(WORD), F.lit(0))


def word_weights(df: DataFrame, text: str, templates: tuple[Template, ...]) -> dict[str, float]:
    """Inverse document frequency, over all texts, of each word of the templates: one number per word."""
    known = sorted({word for template in templates for word in template.words.split()})
    held = df.select(F.explode(F.array_append(F.array_intersect(words(F.col(text)), F.array(*map(F.lit, known))), F.lit(""))).alias("word"))
    counts = {row.word: row.n for row in held.groupBy("word").agg(F.count(F.lit(1)).alias("n")).collect()}
    total = counts.get("", 0)
    return {word: math.log((total + 2) / (counts.get(word, 0) + 1)) for word in known}


def rare_index(templates: tuple[Template, ...], weights: dict[str, float], rare_words: int = RARE_WORDS) -> dict[str, list[tuple[int, int]]]:
    """word -> (template, place in it), for the words of highest weight of each template's key phrase."""
    index: dict[str, list[tuple[int, int]]] = {}
    for number, template in enumerate(templates):
        key = template.key.split()
        rare = sorted(set(key), key=lambda word: (-weights[word], word))[: max(1, rare_words)]
        for place, word in enumerate(template.words.split()):
            if word in rare:
                index.setdefault(word, []).append((number, place))
    return index


def _texts(values: list[str]) -> str:
    return "array(" + ", ".join(f"'{value}'" for value in values) + ")"


def scan(
    df: DataFrame, text: str = "text", templates: tuple[Template, ...] = TEMPLATES,
    rare_words: int = RARE_WORDS, min_share: float = MIN_SHARE,
) -> DataFrame:
    """The frame with ``n_words`` and ``notices``: (template, label, base, start, share) of each notice.

    ``start`` counts words from 0 and is where the template begins, for a template whose beginning
    lies before the text less than 0. ``share`` (0 to 1) is the weight of the words in place. Notices
    of base templates are their phrase, word by word, at every place where it stands; those of others
    hold their key phrase and at least ``min_share`` of the weight. Ties and notices that overlap are
    all named. A null or empty text has no words and no notices; repeated rows come out repeated; an
    empty table gives an empty table. Columns already named as the new ones are replaced, others pass
    through. Weights come from all texts of the frame, in a job of its own when this is called.
    """
    weights = word_weights(df, text, templates)
    index = rare_index(templates, weights, rare_words)
    if text.lower() in ("n_words", "notices"):
        raise ValueError(f"column {text} is read, so it cannot be written too")
    kept = df.select(*all_but(df, "n_words", "notices"))
    own, at = fresh(kept, "words", "n_words", "notices"), fresh(kept, "starts", "n_words", "notices")
    with_words = kept.withColumn(own, words(quoted(text)))
    postings = "map(" + ", ".join(
        f"'{word}', array({', '.join(f'named_struct(\'template\', {number}, \'place\', {place})' for number, place in found)})"
        for word, found in sorted(index.items())
    ) + ")"
    # Starts that the rare words point at: (template, start), each once.
    starts = f"""
        array_distinct(flatten(transform(
            filter(sequence(0, size({own}) - 1), at -> array_contains({_texts(sorted(index))}, {own}[at])),
            at -> transform({postings}[{own}[at]], hit -> named_struct('template', hit.template, 'start', at - hit.place))
        )))"""
    details = []
    for template in templates:
        parts, key = template.words.split(), template.key.split()
        offset = next(i for i in range(len(parts)) if parts[i : i + len(key)] == key)
        total = sum(weights[word] for word in parts)
        placed = ", ".join(f"named_struct('word', '{word}', 'place', {place}, 'weight', {weights[word] / total!r}D)" for place, word in enumerate(parts))
        details.append(
            f"named_struct('label', '{template.label}', 'base', {str(template.base).lower()}, 'key', {_texts(key)}, 'offset', {offset}, 'placed', array({placed}))"
        )
    # get() gives null outside of the text, so a notice may lie over its ends; slice() would not.
    share = f"""
        aggregate({{details}}[each.template].placed, 0D, (sum, one) ->
            sum + if(get({own}, each.start + one.place) <=> one.word, one.weight, 0D))"""
    details_sql = f"array({', '.join(details)})"
    measured = f"""
        transform(
            filter({at}, each ->
                each.start + {details_sql}[each.template].offset >= 0
                AND slice({own}, each.start + {details_sql}[each.template].offset + 1, size({details_sql}[each.template].key)) = {details_sql}[each.template].key),
            each -> named_struct(
                'template', each.template, 'label', {details_sql}[each.template].label, 'base', {details_sql}[each.template].base,
                'start', each.start, 'share', least(1D, {share.format(details=details_sql)})))"""
    # Only texts that hold a rare word are looked at word by word.
    likely = quoted(text).rlike("(?i)" + "|".join(sorted(index)))
    empty = F.expr("cast(array() AS array<struct<template:int,start:int>>)")
    found = with_words.withColumn(at, F.when(likely & (F.size(own) > 0), F.expr(starts)).otherwise(empty))
    found = found.withColumn("notices", F.expr(measured)).withColumn("n_words", F.size(own).cast("long"))
    whole = F.filter("notices", lambda each: each["share"] >= F.when(each["base"], 1 - 1e-9).otherwise(F.lit(min_share)))
    return found.withColumn("notices", whole).drop(own, at)


def labels(notices: Column) -> Column:
    """Distinct labels, sorted and joined by commas."""
    return F.array_join(F.array_sort(F.array_distinct(F.transform(notices, lambda each: each["label"]))), ",")
