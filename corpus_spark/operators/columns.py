"""Column lookup by alias, guards and null fills. Only schemas are read; no job runs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Lookup order of the logical columns.
SOURCE_ALIASES = ("transliteration", "source")
TARGET_ALIASES = ("translation", "target")
SPLIT_KEY_ALIASES = ("text_id", "id")
SUBMISSION_ID_ALIASES = ("id", "text_id")
PREDICTION_ALIASES = ("prediction_clean", "prediction")


def column(name: str) -> Column:
    """A column by its exact name, whatever characters the name holds."""
    return F.col("`" + name.replace("`", "``") + "`")


def find_column(df: DataFrame, *aliases: str) -> str | None:
    """The first alias the frame has, ignoring case; two columns equal up to case are an error."""
    by_lower: dict[str, list[str]] = {}
    for name in df.columns:
        by_lower.setdefault(name.lower(), []).append(name)
    for alias in aliases:
        names = by_lower.get(alias.lower(), [])
        if len(names) > 1:
            raise ValueError(f"Ambiguous column {alias!r}: found {names}")
        if names:
            return names[0]
    return None


def require_column(df: DataFrame, *aliases: str) -> str:
    """As ``find_column``; a missing column is an error that lists what was found."""
    name = find_column(df, *aliases)
    if name is None:
        raise ValueError(f"Cannot find any of the columns {list(aliases)}. Found: {df.columns}")
    return name


def resolve(df: DataFrame, **aliases: tuple[str, ...]) -> DataFrame:
    """Rename each logical column from the first of its aliases; the other columns stay."""
    found = {require_column(df, *names): logical for logical, names in aliases.items()}
    return df.withColumnsRenamed({old: new for old, new in found.items() if old != new})


def fill_missing(df: DataFrame, **values: str) -> DataFrame:
    """Nulls of the named columns replaced by a text."""
    return df.withColumns({name: F.coalesce(column(name), F.lit(value)) for name, value in values.items()})


def preview(df: DataFrame, rows: int = 5, width: int = 100) -> DataFrame:
    """The first rows with long texts cut, for a look."""
    return df.limit(rows).select(
        *[
            F.substring(column(field.name), 1, width).alias(field.name)
            if field.dataType.simpleString() == "string" else column(field.name)
            for field in df.schema.fields
        ]
    )
