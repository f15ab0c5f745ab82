"""Sinks: files, tables and manifests."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from newsloom.functions.keys import link_md5, object_key
from newsloom.operators.incremental import first_per_key
from newsloom.sources.files import CSV_OPTIONS

# Fixed value: rows per insert batch.
BATCH_ROWS = 1000

#: Partition column of a table that is kept by key.
BUCKET = "key_bucket"


def write_csv(df: DataFrame, path: str, single_file: bool = False) -> None:
    """`;` CSV with doubled quotes, replacing what is there.

    `single_file` gives one part file for small exports; a large one keeps a
    file per partition.
    """
    (df.coalesce(1) if single_file else df).write.mode("overwrite").options(**CSV_OPTIONS).csv(path)


def write_metrics_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).csv(path)


def write_json(df: DataFrame, path: str) -> None:
    """JSON lines with NULL fields kept; nested columns stay nested."""
    df.write.mode("overwrite").option("ignoreNullFields", False).json(path)


def append_rows(df: DataFrame, path: str, partition_by: list[str] | None = None) -> None:
    """Append a batch as Parquet: all of its files become visible, or none."""
    writer = df.write.mode("append")
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)


def append_jdbc(df: DataFrame, url: str, table: str, properties: dict | None = None) -> None:
    options = {"batchsize": str(BATCH_ROWS), **(properties or {})}
    df.write.format("jdbc").mode("append").options(url=url, dbtable=table, **options).save()


def read_if_there(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame | None:
    """The table, or None where nothing has been written yet."""
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as error:
        if error.getCondition() == "PATH_NOT_FOUND":
            return None
        raise


def reset_table(spark: SparkSession, path: str, schema: T.StructType) -> None:
    """Replace a table by an empty one."""
    spark.createDataFrame([], schema).write.mode("overwrite").option(
        "partitionOverwriteMode", "static"
    ).parquet(path)


def absent_rows(batch: DataFrame, stored: DataFrame, key: str, order: list[str]) -> DataFrame:
    """First row of each key the table does not hold; only the key is read from it."""
    firsts = first_per_key(batch, key, order)
    return firsts.join(stored.select(key), key, "left_anti")


def key_bucket(key: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int")


def stored_beside(batch: DataFrame, path: str, key: str, buckets: int) -> DataFrame | None:
    """Of a table kept by key the buckets that a batch can meet; None where there is no table.

    The buckets of the batch, at most `buckets` numbers, become a partition
    filter: a small batch reads a small part of a large table.
    """
    stored = read_if_there(batch.sparkSession, path, T.StructType([*batch.schema, T.StructField(BUCKET, T.IntegerType())]))
    if stored is None:
        return None
    met = [r[0] for r in batch.select(key_bucket(F.col(key), buckets)).distinct().collect()]
    return stored.filter(F.col(BUCKET).isin(met))


def insert_if_absent(
    batch: DataFrame, path: str, key: str, order: list[str], buckets: int | None = None
) -> None:
    """Insert the rows of a batch whose key is new; of equal keys the first wins.

    Rows with a missing or empty key are never inserted. A repeated run of the
    same batch adds nothing. With `buckets` the table is kept by key: it has a
    partition column `key_bucket`, always the same number of buckets, and a
    batch is compared with the buckets that its keys fall into, not with the
    keys of the whole table.
    """
    spark = batch.sparkSession
    batch = batch.filter(F.col(key) != "")
    if buckets:
        stored = stored_beside(batch, path, key, buckets)
    else:
        stored = read_if_there(spark, path, batch.schema)
    new = first_per_key(batch, key, order) if stored is None else absent_rows(batch, stored, key, order)
    new = new.select(*batch.columns)
    if buckets:
        # A file per bucket and batch.
        bucketed = new.withColumn(BUCKET, key_bucket(F.col(key), buckets)).repartition(BUCKET)
        append_rows(bucketed, path, [BUCKET])
    else:
        append_rows(new, path)


def image_manifest(listing: DataFrame) -> DataFrame:
    """Images to store: article key, image key, source address, object name."""
    return listing.filter(F.col("image") != "").select(
        F.col("hash_id").alias("article_hash"),
        link_md5(F.col("image")).alias("image_hash"),
        F.col("image").alias("s3_link"),
        object_key(F.col("hash_id")).alias("object_key"),
    )
