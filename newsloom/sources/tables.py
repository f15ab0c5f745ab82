"""Parquet tables and the canonical frames derived from them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from newsloom.functions.keys import link_md5, link_sha256


def read_table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder.rstrip('/')}/{name}.parquet")


def document_link(source: Column, doc_id: Column) -> Column:
    return F.concat(source, F.lit("/"), doc_id.cast("string"))


def articles(spark: SparkSession, folder: str) -> DataFrame:
    """`documents` in the shape of the article table (unselected columns are pruned)."""
    docs = read_table(spark, folder, "documents")
    link = document_link(F.col("source"), F.col("doc_id"))
    return docs.select(
        "doc_id",
        link_sha256(link).alias("article_hash"),
        F.element_at(F.split("text", "\n"), 1).alias("article_title"),
        F.col("lang").alias("category"),
        (
            F.lit("2024-01-01 00:00:00").cast("timestamp_ntz")
            + F.expr("doc_id * INTERVAL '1' MINUTE")
        ).alias("publish_date"),
        F.col("text").alias("article_body"),
        F.col("source").alias("source_entity"),
        link.alias("article_link"),
    )


def scored_articles(spark: SparkSession, folder: str) -> DataFrame:
    """Articles with their scores; an unlabelled article keeps NULL scores."""
    labels = read_table(spark, folder, "labels").select(
        "doc_id",
        F.col("toxic").cast("double").alias("negative_score"),
        F.col("quality").cast("double").alias("importance_score"),
    )
    return articles(spark, folder).join(labels, "doc_id", "left")


def arrivals(spark: SparkSession, folder: str) -> DataFrame:
    """`events` as captured listing rows; the same key arrives many times."""
    link = F.concat_ws("/", F.col("user_id").cast("string"), F.col("event_type"))
    return read_table(spark, folder, "events").select(
        "event_id",
        "ts",
        F.col("event_type").alias("entity"),
        (F.col("user_id") % 5).alias("category"),
        link.alias("link"),
        link_md5(link).alias("article_hash"),
        "props",
    )


def chunk_pairs(spark: SparkSession, folder: str) -> DataFrame:
    """User turns with the assistant turn that follows: (reference, summary)."""
    turns = read_table(spark, folder, "conversations")
    asked = turns.filter("role = 'user'").select(
        "conv_id", F.col("turn"), F.col("text").alias("reference")
    )
    answered = turns.filter("role = 'assistant'").select(
        "conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("summary")
    )
    return asked.join(answered, ["conv_id", "turn"])


def dictionary(spark: SparkSession, folder: str) -> DataFrame:
    """Known words: the distinct lower-case words of `benchmark`."""
    from newsloom.functions.text import letters_only, words

    return (
        read_table(spark, folder, "benchmark")
        .select(F.explode_outer(words(letters_only(F.lower("text")))).alias("word"))
        .filter("word is not null")
        .distinct()
    )
