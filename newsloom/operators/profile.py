"""Length and date profiles of article tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from newsloom.functions.arrays import exploded
from newsloom.functions.text import CHUNK_CHARS, greedy_chunks, sentences

# The inclusive band of usual body lengths, and the bands looked at.
USUAL_LENGTH = (500, 5000)
INSPECTED_BANDS = ((0, 250), (5000, 5100), (7000, 10000))


def drop_null_body(df: DataFrame, body: str = "article_body") -> DataFrame:
    return df.dropna(subset=[body])


def usual_length(df: DataFrame, body: str = "article_body", band=USUAL_LENGTH) -> DataFrame:
    """Rows inside the length band; a missing body has no length and drops."""
    return df.filter(F.length(body).between(*band))


def length_bands(df: DataFrame, body: str = "article_body", bands=INSPECTED_BANDS) -> DataFrame:
    """Rows of the inspected bands; a row is listed once per band it falls in."""
    length = F.length(body)
    hits = F.array_compact(
        F.array(
            *[
                F.when(
                    length.between(lo, hi),
                    F.struct(F.lit(lo).alias("low"), F.lit(hi).alias("high")),
                )
                for lo, hi in bands
            ]
        )
    )
    outer = F.least(*[F.lit(lo) for lo, _ in bands]), F.greatest(*[F.lit(hi) for _, hi in bands])
    return (
        exploded(df.filter(length.between(*outer)), df.columns, hits, "band")
        .select(*df.columns, "band.low", "band.high")
    )


def outlier_counts(df: DataFrame, body: str = "article_body", band=USUAL_LENGTH) -> DataFrame:
    length = F.length(body)
    return df.agg(
        F.count_if(length < band[0]).alias("below"),
        F.count_if(length > band[1]).alias("above"),
        F.count(F.lit(1)).alias("rows"),
    )


def length_profile(df: DataFrame, columns: dict[str, str]) -> DataFrame:
    """Truncated mean, minimum and maximum length per named text column."""
    measures = []
    for name, column in columns.items():
        length = F.length(column)
        measures += [
            F.avg(length).cast("bigint").alias(f"avg_{name}"),
            F.min(length).cast("bigint").alias(f"min_{name}"),
            F.max(length).cast("bigint").alias(f"max_{name}"),
        ]
    return df.agg(*measures)


def describe(df: DataFrame, value: Column) -> DataFrame:
    """Count, mean, sample deviation, minimum, exact quartiles and maximum.

    All of it comes from a histogram: lengths have few distinct values however
    many rows there are, so the last step meets a small table and the exact
    quartiles hold no per-task state of the input.
    """
    counts = (
        df.select(value.alias("v"))
        .filter("v is not null")
        .groupBy("v")
        .agg(F.count(F.lit(1)).alias("n"))
    )
    v, n = F.col("v").cast("double"), F.col("n")
    total, first = F.sum(n), F.sum(v * n)
    # Around the mean: squares of values far from 0 would drown their spread.
    apart = F.sum(n * F.pow(v - counts.agg(first / total).scalar(), 2))
    return counts.agg(
        F.coalesce(total, F.lit(0)).alias("count"),
        (first / total).alias("mean"),
        F.when(total > 1, F.sqrt(apart / (total - 1))).alias("std"),
        F.min(v).alias("min"),
        F.percentile(v, 0.25, n).alias("p25"),
        F.percentile(v, 0.5, n).alias("p50"),
        F.percentile(v, 0.75, n).alias("p75"),
        F.max(v).alias("max"),
    )


def date_span(df: DataFrame, date: str = "publish_date") -> DataFrame:
    """First and last date and the whole seconds between them."""
    return df.agg(F.min(date).alias("first_date"), F.max(date).alias("last_date")).withColumn(
        "span_seconds", F.timestamp_diff("SECOND", F.col("first_date"), F.col("last_date"))
    )


def column_profile(df: DataFrame) -> DataFrame:
    """Non-null count and type per column, from one pass over the table."""
    counts = df.agg(*[F.count(c).alias(c) for c in df.columns])
    rows = F.array(
        *[
            F.struct(
                F.lit(name).alias("column_name"),
                F.lit(dtype).alias("dtype"),
                F.col(name).alias("non_null"),
            )
            for name, dtype in df.dtypes
        ]
    )
    return counts.select(F.inline(rows))


def frame_shape(df: DataFrame) -> DataFrame:
    return df.agg(F.count(F.lit(1)).alias("rows")).withColumn("columns", F.lit(len(df.columns)))


def sorted_curve(df: DataFrame, value: Column, bucket: int = 1024, block: int = 100_000) -> DataFrame:
    """Sorted values with their zero-based rank, without a global sort.

    Equal values are interchangeable in the curve, so a histogram holds it all.
    Running counts are taken inside buckets of neighbouring values and over the
    bucket totals; a value that many rows share is written out in blocks, dealt
    over the tasks.
    """
    counts = (
        df.select(value.alias("value"))
        .filter("value is not null")
        .groupBy("value")
        .agg(F.count(F.lit(1)).alias("n"))
        .withColumn("bucket", F.floor(F.col("value") / bucket))
    )
    totals = counts.groupBy("bucket").agg(F.sum("n").alias("total"))
    # One row per bucket of values: the number of buckets is bounded by the longest text.
    earlier = W.orderBy("bucket").rowsBetween(W.unboundedPreceding, -1)
    offsets = totals.select(
        "bucket", F.coalesce(F.sum("total").over(earlier), F.lit(0)).alias("offset")
    )
    inside = W.partitionBy("bucket").orderBy("value").rowsBetween(W.unboundedPreceding, -1)
    starts = (
        counts.withColumn("before", F.coalesce(F.sum("n").over(inside), F.lit(0)))
        .join(offsets, "bucket")
        .select("value", "n", (F.col("offset") + F.col("before")).alias("start"))
    )
    blocks = starts.withColumn(
        "at", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("n") - 1, F.lit(block).cast("bigint")))
    )
    dealt = blocks.repartition("value", "at")
    length = F.least(F.lit(block), F.col("n") - F.col("at"))
    return dealt.select(
        F.explode(
            F.sequence(F.col("start") + F.col("at"), F.col("start") + F.col("at") + length - 1)
        ).alias("rank"),
        "value",
    )


def sample_rows(df: DataFrame, key: str, n: int, seed: int = 0, digits: int = 4, few: int = 10_000) -> DataFrame:
    """Exactly n rows in a random but repeatable order of their keys; all rows, if they are fewer.

    The order is that of a digest of the key. Counts by its first `digits`
    hex digits, at most 16**digits numbers, tell which rows are in for sure and
    the one group that the n-th row falls into; only that group, counted again
    by further digits while it has more than `few` rows, is sorted.
    """
    digest = F.coalesce(F.md5(F.concat(F.col(key).cast("string"), F.lit(f"-{seed}"))), F.lit(""))
    marked = df.withColumn("_digest", digest)
    group, left, size = "", n, 0
    while size < 32:
        inside = marked.filter(F.substring("_digest", 1, size) == group)
        counts = inside.groupBy(F.substring("_digest", 1, size + digits).alias("g")).count().collect()
        size += digits
        met = None
        for met in sorted(counts, key=lambda r: r["g"]):
            if met["count"] >= left:
                break
            left -= met["count"]
        else:
            if met is None or size == digits:
                return marked.orderBy("_digest", key).drop("_digest")
        group = met["g"]
        if met["count"] <= few:
            break
    start = F.substring("_digest", 1, size)
    edge = marked.filter(start == group).orderBy("_digest", key).limit(left)
    # In the order of the digests; the sort deals the rows by range.
    return marked.filter(start < group).unionByName(edge).orderBy("_digest", key).drop("_digest")


def head(df: DataFrame, order: list[str], n: int = 5) -> DataFrame:
    return df.orderBy(*order).limit(n)


def chunk_stats(df: DataFrame, body: str = "article_body", size: int = CHUNK_CHARS) -> DataFrame:
    """Parts, wanted and resulting chunks per article."""
    keep = [c for c in df.columns if c != body]
    length = F.length(body)
    return (
        df.select(*keep, length.alias("n_chars"), sentences(F.col(body)).alias("_parts"))
        .select(
            *keep,
            "n_chars",
            F.size("_parts").alias("n_parts"),
            F.floor(F.col("n_chars") / size).alias("whole_chunks"),
            F.round(F.col("n_chars") / float(size), 2).alias("wanted_chunks"),
            F.size(greedy_chunks(F.col("_parts"), size)).alias("n_chunks"),
        )
    )
