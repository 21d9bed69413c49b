"""Corpus chrF++: tokens, per-row counts and the closing formula (Popović 2015, 2017)."""

from __future__ import annotations

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F

from corpus_spark.functions.ngrams import char_ngram_counts, substitute, word_ngram_counts
from corpus_spark.functions.text import squeeze

CHAR_ORDER = 6
WORD_ORDER = 2
BETA = 2

# ASCII punctuation as a regex class, one by one so that Java looks it up in a table.
PUNCTUATION = r"""[!"#$%&'()*+,\-./:;<=>?@\[\\\]^_`{|}~]"""

# The same split with spaces around every word: first words that only start with punctuation, then those that end with it.
WORD_RULES = (
    (f" ({PUNCTUATION})([^ ]*[^ {PUNCTUATION[1:]}) ", " $1 $2 "),
    (f" ([^ ]+)({PUNCTUATION}) ", " $1 $2 "),
)


def split_punctuation(text: Column) -> Column:
    """Words of two or more characters give up their last character if it is punctuation, else
    their first; words joined by single spaces.

    The words that only start with punctuation go first: what is left of them does not end with
    it. Both patterns begin with the punctuation itself, so the scan stops nowhere else.
    """
    value = squeeze(F.coalesce(text, F.lit("")))
    mark, not_ending = PUNCTUATION, f"[^ ]++(?<!{PUNCTUATION})"
    value = F.regexp_replace(value, f"({mark})(?<![^ ]{mark})(?={not_ending})", "$1 ")
    return F.regexp_replace(value, f"({mark})(?<=[^ ]{mark})(?![^ ])", " $1")


def _without_spaces(texts: pa.Array) -> pa.Array:
    return pc.replace_substring(texts, " ", "")


def _split(texts: pa.Array) -> pa.Array:
    """Words as ``split_punctuation`` has them. Each word gets spaces of its own, as a match takes them with it."""
    texts = pc.binary_join_element_wise("", pc.replace_substring(texts, " ", "  "), "", " ")
    return substitute(texts, WORD_RULES)


def chrf_char_counts(hyp: Column, ref: Column) -> Column:
    """Flat ``[hyp, ref, match]`` per character order 1..6, blanks removed."""
    blank = F.lit("")
    return char_ngram_counts(squeeze(F.coalesce(hyp, blank)), squeeze(F.coalesce(ref, blank)), CHAR_ORDER, _without_spaces)


def chrf_word_counts(hyp: Column, ref: Column) -> Column:
    """Flat ``[hyp, ref, match]`` per word order 1..2."""
    blank = F.lit("")
    return word_ngram_counts(squeeze(F.coalesce(hyp, blank)), squeeze(F.coalesce(ref, blank)), WORD_ORDER, _split)


def chrf_score(hyp: list[str], ref: list[str], match: list[str]) -> Column:
    """F-score, 0 to 100, of columns with summed counts, named per order: precision and recall
    averaged over the orders both sides have, recall weighted by beta squared."""
    ratios = ", ".join(
        f"IF({n_hyp} > 0 AND {n_ref} > 0, struct(double({n_match}) / {n_hyp} AS p, double({n_match}) / {n_ref} AS r), NULL)"
        for n_hyp, n_ref, n_match in zip(hyp, ref, match)
    )
    start = "struct(0D AS p, 0D AS r, 0D AS n)"
    factor = BETA * BETA
    return F.expr(
        f"aggregate(filter(array({ratios}), x -> x IS NOT NULL), {start}, "
        f"(a, x) -> struct(a.p + x.p AS p, a.r + x.r AS r, a.n + 1D AS n), "
        f"a -> IF(a.p + a.r > 0, 100D * {1 + factor} * a.p * a.r / (a.n * ({factor} * a.p + a.r)), 0D))"
    )
