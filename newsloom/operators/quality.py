"""Key checks a database would enforce."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def key_violations(df: DataFrame, key: str) -> DataFrame:
    """Keys held by several rows, with their count."""
    return df.groupBy(key).agg(F.count(F.lit(1)).alias("n")).filter("n > 1")


def orphans(child: DataFrame, parent: DataFrame, key: str) -> DataFrame:
    """Child rows without a parent."""
    return child.join(parent.select(key).distinct(), key, "left_anti")


def with_parent(child: DataFrame, parent: DataFrame, key: str) -> DataFrame:
    """Child rows that have a parent."""
    return child.join(parent.select(key).distinct(), key, "left_semi")
