"""Blank handling, words and prefixes.

``WS`` is the blank class every operator shares: Java's Unicode white space plus the four ASCII
separators U+001C..U+001F, which together are the characters Python's ``str.split`` splits on.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

WS = r"(?U:[\s\x1c-\x1f])"
NOT_WS = r"(?U:[^\s\x1c-\x1f])"
# The same characters one by one.
BLANKS = "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"


def has_text(text: Column) -> Column:
    """True where the value holds at least one non-blank character; never null."""
    return F.coalesce(text.rlike(NOT_WS), F.lit(False))


def is_blank(text: Column) -> Column:
    """True for null, empty and all-blank values."""
    return ~has_text(text)


def squeeze(text: Column) -> Column:
    """Runs of blanks become one space; the ends are stripped."""
    return F.trim(F.regexp_replace(text, WS + "+", " "))


def drop_blanks(text: Column) -> Column:
    """All blanks removed."""
    return F.regexp_replace(text, WS + "+", "")


def words(text: Column) -> Column:
    """Blank-separated words as an array; empty for blank text."""
    return F.filter(F.split(text, WS + "+"), lambda word: word != "")


def join_words(array: Column) -> Column:
    return F.array_join(array, " ")


def strip_prefix(text: Column, prefix: str) -> Column:
    """The text without a literal prefix, unchanged where the prefix is absent."""
    return F.regexp_replace(text, r"\A\Q" + prefix.replace(r"\E", r"\E\\E\Q") + r"\E", "")


def code_points(text: Column) -> Column:
    """Length in code points."""
    return F.length(text)


def drop_spans(text: Column, opening: str, closing: str, within_line: bool = False) -> Column:
    """Each span from an opening mark to the next closing one is removed.

    Nothing after the last closing mark can be part of a span, so that rest is set aside first: every
    opening mark that is looked at then finds its close, and the time stays linear in the text. Where
    spans end with the line, the lines are taken one by one.
    """
    span = rf"(?s)\Q{opening}\E.*?\Q{closing}\E"

    def dropped(part: Column) -> Column:
        rest = F.substring_index(part, closing, -1)
        head = F.left(part, F.length(part) - F.length(rest))
        return F.concat(F.regexp_replace(head, span, ""), rest)

    if within_line:
        return F.array_join(F.transform(F.split(text, "\n", -1), dropped), "\n")
    # A list of one, so that the text is computed once.
    return F.get(F.transform(F.array(text), dropped), F.lit(0))
