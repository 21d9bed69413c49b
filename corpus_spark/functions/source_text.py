"""Cleaning of raw transliterations and light cleaning of their translations.

The steps run in the listed order, and the order matters: angle brackets go before the gap marks
are written, so a gap mark made here survives while one already in the input loses its brackets.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from corpus_spark.functions.text import WS, drop_spans, squeeze
from corpus_spark.functions.unicode import nfc

# Characters, marks and labels that decide results.
BREVE_FROM, BREVE_TO = "Ḫḫ", "Hh"
HALF_BRACKETS = "˹˺"
CERTAINTY_MARKS = "!?"
LINE_DIVIDERS = "/:"
SUBSCRIPTS = "₀₁₂₃₄₅₆₇₈₉"
SUPERSCRIPTS = "⁰¹²³⁴⁵⁶⁷⁸⁹"
DIGITS = "0123456789"
LONG_GAP, SHORT_GAP = "<big_gap>", "<gap>"
SURFACE_LABELS = r"o|r|rev|obv|lo\.?e\.?|u\.?e\.?"
PRIMES = "'′"
LONG_GAP_PATTERN = r"\[\.\.\.\s*\.\.\.?\]"


def plain_h(text: Column) -> Column:
    return F.translate(text, BREVE_FROM, BREVE_TO)


def drop_half_brackets(text: Column) -> Column:
    return F.translate(text, HALF_BRACKETS, "")


def drop_double_angles(text: Column) -> Column:
    """``<<...>>`` goes with its content, within a line."""
    return drop_spans(text, "<<", ">>", within_line=True)


def unwrap_angles(text: Column) -> Column:
    """``<...>`` loses its brackets and keeps its content, within a line."""
    return F.regexp_replace(text, "<([^>\n]*+)>", "$1")


def mark_long_gaps(text: Column) -> Column:
    """Bracketed dots, three then two or three, become the long gap mark."""
    return F.regexp_replace(text, LONG_GAP_PATTERN.replace(r"\s", WS), LONG_GAP)


def mark_short_gaps(text: Column) -> Column:
    """``[x]``, ``[x x]`` and so on become the short gap mark."""
    return F.regexp_replace(text, rf"\[x(?:{WS}+x)*+\]", SHORT_GAP)


def unwrap_brackets(text: Column) -> Column:
    """``[...]`` loses its brackets and keeps its content, within a line."""
    return F.regexp_replace(text, r"\[([^\]\n]*+)\]", "$1")


def drop_certainty_marks(text: Column) -> Column:
    return F.translate(text, CERTAINTY_MARKS, "")


def space_for_divider(text: Column, divider: str) -> Column:
    """A line divider and the blanks around it become one space."""
    return F.regexp_replace(text, rf"{WS}*{divider}{WS}*", " ")


def plain_digits(text: Column) -> Column:
    return F.translate(text, SUBSCRIPTS + SUPERSCRIPTS, DIGITS + DIGITS)


def drop_line_number(text: Column) -> Column:
    """One leading line number with its dot, and a surface label before it, are removed."""
    label = rf"(?:(?:{SURFACE_LABELS})\.?{WS}+)?"
    return F.regexp_replace(text, rf"\A{label}\p{{Nd}}+[{PRIMES}]?\.{WS}*", "")


def clean_source_stepwise(text: Column, normalize: bool = True) -> Column:
    """The cleaner spelled out step by step; ``clean_source`` gives the same values faster."""
    value = F.coalesce(nfc(text) if normalize else text, F.lit(""))
    for step in (
        plain_h, drop_half_brackets, drop_double_angles, unwrap_angles,
        mark_long_gaps, mark_short_gaps, unwrap_brackets, drop_certainty_marks,
    ):
        value = step(value)
    for divider in LINE_DIVIDERS:
        value = space_for_divider(value, divider)
    return squeeze(drop_line_number(plain_digits(value)))


def clean_source(text: Column, normalize: bool = True) -> Column:
    """Clean a raw transliteration; null and blank give ``""``.

    Character-level steps that do not see each other's output share one ``translate``. Dividers
    may become a bare space there, because the blanks around them collapse in the last step.
    """
    value = F.coalesce(nfc(text) if normalize else text, F.lit(""))
    value = F.translate(value, BREVE_FROM + HALF_BRACKETS, BREVE_TO)
    value = unwrap_brackets(mark_short_gaps(mark_long_gaps(unwrap_angles(drop_double_angles(value)))))
    value = F.translate(
        value,
        LINE_DIVIDERS + SUBSCRIPTS + SUPERSCRIPTS + CERTAINTY_MARKS,
        " " * len(LINE_DIVIDERS) + DIGITS + DIGITS,
    )
    return squeeze(drop_line_number(value))


def clean_target(text: Column) -> Column:
    """Clean a translation: blanks only; null and blank give ``""``."""
    return squeeze(F.coalesce(text, F.lit("")))
