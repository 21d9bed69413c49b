"""Column names that a frame does not have yet."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def fresh(df: DataFrame, name: str, *others: str) -> str:
    """The name with as many underscores after it as it takes to be no column of the frame, in any case, nor one of the others."""
    taken = {each.lower() for each in (*df.columns, *others)}
    while name.lower() in taken:
        name += "_"
    return name


def quoted(name: str) -> Column:
    """A column by its exact name, whatever characters the name holds."""
    return F.col("`" + name.replace("`", "``") + "`")


def all_but(df: DataFrame, *names: str) -> list[Column]:
    """The frame's columns without those of the names, in any case."""
    gone = {name.lower() for name in names}
    return [quoted(name) for name in df.columns if name.lower() not in gone]
