"""Rows from array columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def exploded(df: DataFrame, keep: list, array: Column, name: str) -> DataFrame:
    """One row per non-null element.

    The outer form with a filter behind it, because the planner adds a size
    filter in front of the inner form, which would compute a costly array twice.
    """
    return df.select(*keep, F.explode_outer(array).alias(name)).filter(F.col(name).isNotNull())


def pos_exploded(df: DataFrame, keep: list, array: Column, pos: str, name: str) -> DataFrame:
    """One row per non-null element with its zero-based position."""
    rows = df.select(*keep, F.posexplode_outer(array).alias(pos, name))
    return rows.filter(F.col(name).isNotNull())
