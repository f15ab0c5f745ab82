"""Negativity filter, importance ranking and reader digests."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from newsloom.operators.incremental import within_hours


def below_negativity(df: DataFrame, threshold: float = 0.5) -> DataFrame:
    """Rows below the threshold; an unscored row does not pass."""
    return df.filter(F.col("negative_score") < threshold)


def top_by_importance(df: DataFrame, k: int, tie: str, by: str = "category") -> DataFrame:
    """The k most important rows per group, unscored ones last.

    The rank filter also runs before the shuffle (partial window group limit):
    a group of any size sends k rows per input partition.
    """
    order = W.partitionBy(by).orderBy(F.col("importance_score").desc_nulls_last(), F.col(tie))
    return df.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def digest(
    scored: DataFrame,
    preferences: DataFrame,
    as_of,
    k: int = 5,
    tie: str = "article_hash",
    hours: int = 48,
    threshold: float = 0.5,
) -> DataFrame:
    """Latest, not too negative, most important articles for each reader.

    Ranked once per category before the readers come in, so the reader side
    meets k rows per category and not every article.
    """
    recent = within_hours(scored, as_of, hours)
    best = top_by_importance(below_negativity(recent, threshold), k, tie)
    return preferences.join(best, "category")
