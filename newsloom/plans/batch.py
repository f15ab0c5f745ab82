"""The two loading flows as one lazy plan each."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from newsloom.functions.text import greedy_chunks, sentences
from newsloom.operators import incremental as I
from newsloom.operators import ingest as G
from newsloom.operators.summarise import summarise_chunks
from newsloom.schema import ARTICLE
from newsloom.sources.sinks import absent_rows

# Column of the article table -> column of a completed listing row.
_FROM_LISTING = {
    "article_hash": "hash_id",
    "article_title": "title",
    "source_entity": "entity",
    "article_link": "link",
}


def to_article(rows: DataFrame) -> DataFrame:
    """Rows in the column order and types of the article table; absent columns are NULL."""

    def column(field) -> Column:
        names = [field.name, _FROM_LISTING.get(field.name)]
        found = next((n for n in names if n in rows.columns), None)
        value = F.col(found) if found else F.lit(None)
        return value.cast(field.dataType).alias(field.name)

    return rows.select(*[column(f) for f in ARTICLE.fields])


def bullet_summary(body: Column, method: str = "central") -> Column:
    """One line per chunk of a body, by the built-in summariser."""
    return F.array_join(summarise_chunks(greedy_chunks(sentences(body)), method), "\n")


def load_by_key(
    lists: list[DataFrame],
    stored: DataFrame,
    bodies: DataFrame,
    views: DataFrame,
    method: str = "central",
) -> DataFrame:
    """Article rows to append from several listings, keyed by link hash.

    Earlier lists win over later ones, and keys the table holds are skipped
    before any body is joined: that covers the keys seen in the last 48 hours
    as well as older ones, with one comparison. A missing date is filled from
    the page, and the summary is made last, for new rows only.
    """
    union = I.union_lists(*lists).withColumn("article_hash", F.col("hash_id"))
    fresh = absent_rows(union, stored, "article_hash", ["list_no", "pos"]).drop("article_hash")
    complete = G.complete_articles(fresh, bodies, views)
    summary = bullet_summary(F.col("article_body"), method).alias("generated_summary")
    return to_article(complete.select("*", summary))


def load_by_date(
    listing: DataFrame,
    stored: DataFrame,
    bodies: DataFrame,
    as_of,
    order: str = "pos",
    body_order: list[str] | None = None,
) -> DataFrame:
    """Article rows to append from one listing per target, newest first.

    Every list is read down to its first row that is not newer than the cut. A
    link listed twice is taken once, with the first body in `body_order`; `bodies` are merged from the
    left, so a failed page leaves NULLs. Nothing is appended when no body at all
    could be read.
    """
    by = ["source_entity", "category"]
    targets = listing.select(*by).distinct()
    cuts = I.cut_dates(targets, stored, as_of, by)
    newer = I.take_while_newer(listing, cuts.select(*by, "cut_date"), by, order, "publish_date")
    merged = G.left_merge(
        I.first_per_key(newer, "article_hash", [order]),
        bodies,
        order=body_order,
    )
    any_body = bodies.limit(1).agg(F.count(F.lit(1))).scalar()
    return to_article(merged.filter(any_body > 0))
