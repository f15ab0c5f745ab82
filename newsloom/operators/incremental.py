"""Incremental loading: cut dates, seen keys, first-wins and take-while."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from newsloom.functions.dates import as_column, before, lookback_floor


def latest(df: DataFrame, column: str = "ts") -> Column:
    """Largest value of a column, as a scalar subquery of the query that uses it."""
    return df.agg(F.max(column)).scalar()


def first_per_key(df: DataFrame, key: str | list[str], order: list[str]) -> DataFrame:
    """First row of each key in the given order.

    The rank filter is applied inside every input partition before the shuffle
    (partial window group limit), so a key that holds a large share of the rows
    sends one row per partition.
    """
    keys = [key] if isinstance(key, str) else key
    ranked = df.withColumn(
        "_rank", F.row_number().over(W.partitionBy(*keys).orderBy(*[F.col(c) for c in order]))
    )
    return ranked.filter("_rank = 1").drop("_rank")


def last_dates(stored: DataFrame, by: list[str], date: str = "publish_date") -> DataFrame:
    """Latest date per group. NULL dates never count."""
    return stored.filter(F.col(date).isNotNull()).groupBy(*by).agg(F.max(date).alias("last_date"))


def cut_dates(
    targets: DataFrame,
    stored: DataFrame,
    as_of,
    by: list[str] = ["entity", "category"],
    date: str = "publish_date",
    floor: str = "rolling",
) -> DataFrame:
    """Cut-off per target: its latest stored date, never older than the look-back.

    A target without stored rows starts at the look-back.
    """
    oldest = lookback_floor(as_of, floor)
    found = targets.join(last_dates(stored, by, date), by, "left")
    return found.withColumn("cut_date", F.greatest(F.coalesce("last_date", oldest), oldest))


def newer_than(rows: DataFrame, cut, date: str = "ts") -> DataFrame:
    """Rows strictly newer than the cut; an equal time counts as stored."""
    return rows.filter(F.col(date) > as_column(cut))


def since_last_run(rows: DataFrame, stored: DataFrame, as_of, date: str = "ts") -> DataFrame:
    """Rows newer than the stored maximum and inside the 24-hour look-back."""
    last = stored.agg(F.max(date)).scalar()
    floor = before(as_of, 24)
    return newer_than(rows, F.greatest(F.coalesce(last, floor), floor), date)


def within_hours(rows: DataFrame, as_of, hours: int = 48, date: str = "publish_date") -> DataFrame:
    """Rows dated at most `hours` before `as_of`. NULL dates fail."""
    return rows.filter(F.col(date) >= before(as_of, hours))


def unseen(rows: DataFrame, seen: DataFrame, key: str = "article_hash") -> DataFrame:
    """Rows whose key was not seen.

    Only presence counts, so the seen side is reduced to distinct keys before
    it is shuffled or, when the planner measures it as small, broadcast.
    """
    return rows.join(seen.select(key).distinct(), key, "left_anti")


def take_while_newer(
    rows: DataFrame, cuts: DataFrame, by: list[str], order: str, date: str = "ts"
) -> DataFrame:
    """Rows of each list before its first row dated at or before the cut.

    Rows behind that one are dropped even if newer. A row without a date does
    not stop the list. The stopping place is an aggregate per list, joined
    back, so a long list is never gathered in one task.
    """
    dated = rows.join(cuts, by)
    stops = (
        dated.filter(F.col(date) <= F.col("cut_date"))
        .groupBy(*by)
        .agg(F.min(order).alias("_stop"))
    )
    return (
        rows.join(stops, by, "left")
        .filter(F.col("_stop").isNull() | (F.col(order) < F.col("_stop")))
        .drop("_stop")
    )


def lowest_dates(
    rows: DataFrame, by: list[str], order: str, as_of, date: str = "ts"
) -> DataFrame:
    """Lowest date of each list; a list whose first row has no date counts from `as_of`."""
    grouped = rows.groupBy(*by).agg(
        F.min(date).alias("_low"),
        F.min(order).alias("_first"),
        F.min(F.when(F.col(date).isNotNull(), F.col(order))).alias("_first_dated"),
    )
    starts_dated = F.col("_first").eqNullSafe(F.col("_first_dated"))
    low = F.when(starts_dated, F.col("_low")).otherwise(F.least("_low", as_column(as_of)))
    return grouped.select(*by, low.alias("low_date"))


def union_lists(*lists: DataFrame) -> DataFrame:
    """Bag union that remembers which list a row came from, earlier lists first."""
    numbered = [df.withColumn("list_no", F.lit(i)) for i, df in enumerate(lists)]
    result = numbered[0]
    for df in numbered[1:]:
        result = result.unionByName(df)
    return result


def numbered_lists(rows: DataFrame, by: str) -> DataFrame:
    """The rows with the number of their list: one list per value there is, in order, missing values last.

    The values are counted off as a small frame of their own, so the rows are
    read once, whatever the number of lists.
    """
    values = rows.groupBy(F.col(by).alias("_value")).agg(F.lit(1).alias("_one"))
    place = F.row_number().over(W.partitionBy("_one").orderBy(F.col("_value").asc_nulls_last())) - 1
    lists = values.select("_value", place.alias("list_no"))
    return rows.join(lists, F.col(by).eqNullSafe(F.col("_value"))).drop("_value")


def recapture_due(rows: DataFrame, as_of, days: int = 3, captured: str = "capture_date") -> DataFrame:
    """Articles without a body, captured at least `days` ago."""
    return rows.filter(
        F.col("article_body").isNull() & (F.col(captured) <= before(as_of, 24 * days))
    )
