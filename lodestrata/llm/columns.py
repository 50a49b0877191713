"""Columns of any name, dots and backticks included."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def named(df: DataFrame, column: str) -> Column:
    """The column of exactly that name."""
    return df["`" + column.replace("`", "``") + "`"]


def as_row(df: DataFrame, columns: list[str] | None = None) -> Column:
    """A struct of the columns, all unless told."""
    return F.struct(*(named(df, c).alias(c) for c in (df.columns if columns is None else columns)))


def unfolded(row: Column, columns: list[str]) -> list[Column]:
    """The columns of such a struct."""
    return [row.getField(c).alias(c) for c in columns]
