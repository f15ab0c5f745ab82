"""File sources: CSV, JSON, stored pages and API payloads."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from newsloom import schema as S
from newsloom.functions.arrays import pos_exploded
from newsloom.functions.scoring import falsy_to_null

# Fixed values: `;` cells, quotes doubled, empty cell = NULL, "" = empty text.
CSV_OPTIONS = {
    "header": "true",
    "sep": ";",
    "quote": '"',
    "escape": '"',
    "encoding": "UTF-8",
    "ignoreLeadingWhiteSpace": "false",
    "ignoreTrailingWhiteSpace": "false",
}


def read_articles_csv(
    spark: SparkSession, path: str, schema: T.StructType = S.LISTING_EXPORT
) -> DataFrame:
    """Listing export.

    Cells may hold line breaks, so a file is one split: write many files (the
    sink does) rather than one large one. The mark for NULL is a character no
    cell holds: an empty cell gets it from the parser, "" stays an empty text.
    """
    options = {**CSV_OPTIONS, "multiLine": "true", "nullValue": "\0"}
    return spark.read.schema(schema).options(**options).csv(path)


def read_records_json(
    spark: SparkSession, path: str, schema: T.StructType = S.LISTING_EXPORT, one_array: bool = False
) -> DataFrame:
    """JSON records: lines by default, `one_array` for a single top-level array."""
    return spark.read.schema(schema).option("multiLine", one_array).json(path)


def read_experiment_json(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(S.EXPERIMENT).json(path)


def read_metrics_csv(spark: SparkSession, path: str) -> DataFrame:
    """The metrics file: scores by number of chunks."""
    return spark.read.schema(S.METRIC_FRAME).option("header", True).csv(path)


def read_stored_pages(spark: SparkSession, path: str) -> DataFrame:
    """A folder of stored HTML files, one page per file."""
    return spark.read.text(path, wholetext=True).select(
        F.col("_metadata.file_path").alias("url"), F.col("value").alias("html")
    )


def read_images(spark: SparkSession, path: str) -> DataFrame:
    """Stored image bytes, one row per file."""
    return spark.read.format("binaryFile").load(path).select("path", "content")


def read_articles_jdbc(
    spark: SparkSession,
    url: str,
    table: str,
    properties: dict | None = None,
    partition_column: str | None = None,
    bounds: tuple | None = None,
    partitions: int = 1,
) -> DataFrame:
    """Database table; filters and columns used later are pushed to the database.

    With a partition column the read is split into `partitions` range queries.
    """
    reader = spark.read.format("jdbc").options(url=url, dbtable=table, **(properties or {}))
    if partition_column:
        lower, upper = bounds
        reader = reader.options(
            partitionColumn=partition_column,
            lowerBound=str(lower),
            upperBound=str(upper),
            numPartitions=str(partitions),
        )
    return reader.load()


def rows_with_schema(spark: SparkSession, rows: list[dict], schema: T.StructType) -> DataFrame:
    """Driver rows as a frame; a key a row lacks becomes NULL."""
    return spark.createDataFrame(
        [tuple(row.get(name) for name in schema.names) for row in rows], schema
    )


def run_sql(spark: SparkSession, text: str, **frames: DataFrame) -> DataFrame:
    """A SQL text over the given frames, which it names as `{name}`.

    The session's own tables and views can be named too and stay as they are. Errors are raised, not returned.
    """
    return spark.sql(text, **frames)


def view_count(payload: Column) -> Column:
    """Views in a view-counter payload: first element, zero or absent is NULL."""
    return falsy_to_null(F.get(F.from_json(payload, S.VIEW_COUNT), F.lit(0))["Visitas"])


def search_results(payloads: DataFrame, column: str = "payload") -> DataFrame:
    """One row per hit of a search-result payload, in order."""
    parsed = F.from_json(F.col(column), S.SEARCH_PAYLOAD)["news_results"]
    keep = [c for c in payloads.columns if c != column]
    return pos_exploded(payloads, keep, parsed, "pos", "hit").select(
        *keep, "pos", "hit.title", "hit.link", "hit.date"
    )


def read_search_json(spark: SparkSession, path: str) -> DataFrame:
    """Search-result files, one JSON object per file."""
    return (
        spark.read.schema(S.SEARCH_PAYLOAD)
        .option("multiLine", True)
        .json(path)
        .select(F.posexplode("news_results").alias("pos", "hit"))
        .select("pos", "hit.title", "hit.link", "hit.date")
    )
