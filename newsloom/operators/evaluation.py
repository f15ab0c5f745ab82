"""ROUGE over pairs, and means over articles and chunk counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from newsloom.functions.arrays import exploded, pos_exploded
from newsloom.functions.rouge import known_counts, mean_metric, open_counts, scores_of, tokens
from newsloom.functions.scoring import metric
from newsloom.functions.text import text_or_empty
from newsloom.session import dealt_by

# (result column, metric, field)
MEANS = (
    ("meanf1_rouge1", "rouge1", "fmeasure"),
    ("meanf1_rougeL", "rougeL", "fmeasure"),
    ("meanprecision_rouge1", "rouge1", "precision"),
    ("meanprecision_rougeL", "rougeL", "precision"),
    ("meanrecall_rouge1", "rouge1", "recall"),
    ("meanrecall_rougeL", "rougeL", "recall"),
)


def rouge1(pairs: DataFrame, key: list[str], reference: str, summary: str) -> DataFrame:
    """Unstemmed ROUGE-1 of text pairs, as bag counts.

    The pairs are dealt by key while they are compact texts; both token counts
    and their sums then stay in place, so the tokens themselves are never
    shuffled and the work grows with the text and not with its square. Pairs
    whose texts are both empty of tokens score 0.
    """

    def marked(column: str, r: int, h: int) -> Column:
        return F.transform(
            tokens(text_or_empty(F.col(column))),
            lambda t: F.struct(t.alias("token"), F.lit(r).alias("r"), F.lit(h).alias("h")),
        )

    texts = dealt_by(pairs.select(*key, reference, summary), *key)
    none = F.array(F.struct(F.lit("").alias("token"), F.lit(0).alias("r"), F.lit(0).alias("h")))
    both = F.concat(none, marked(reference, 1, 0), marked(summary, 0, 1))
    bags = (
        exploded(texts, key, both, "t")
        .groupBy(*key, "t.token")
        .agg(F.sum("t.r").alias("r"), F.sum("t.h").alias("h"))
    )
    totals = bags.groupBy(*key).agg(
        F.sum(F.least("r", "h")).alias("overlap"),
        F.sum("r").alias("n_ref"),
        F.sum("h").alias("n_sum"),
    )
    return totals.select(
        *key, "overlap", metric(F.col("overlap"), F.col("n_ref"), F.col("n_sum")).alias("m")
    ).select(*key, "overlap", "m.precision", "m.recall", "m.fmeasure")


def add_scores(
    rows: DataFrame,
    references: str,
    summaries: str,
    stem: bool = True,
    metrics: tuple[str, ...] = ("rouge1", "rougeL"),
    scores: str = "scores",
) -> DataFrame:
    """Adds the scores of the i-th summary against the i-th reference of two arrays.

    What one text holds of the other in a row is counted in the JVM; only other
    pairs go to Python, and none for unstemmed ROUGE-1.
    """
    a, b = F.col(references), F.col(summaries)
    known = rows.withColumn("_known", known_counts(a, b, stem))
    if not stem and "rougeL" not in metrics:
        return known.withColumn(scores, scores_of(F.col("_known"), None, metrics)).drop("_known")
    counted = known.withColumn("_open", open_counts(a, b, F.col("_known"), stem))
    return counted.withColumn(scores, scores_of(F.col("_known"), F.col("_open"), metrics)).drop("_known", "_open")


def score_means(
    scored: DataFrame, scores: str = "scores", metrics: tuple[str, ...] = ("rouge1", "rougeL")
) -> DataFrame:
    """Three means per metric and row of an array of scores; the other columns stay."""
    keep = [c for c in scored.columns if c != scores]
    return scored.select(
        *keep, *[mean_metric(F.col(scores), m, f).alias(name) for name, m, f in MEANS if m in metrics]
    )


def means_by_chunks(means: DataFrame) -> DataFrame:
    """Score columns per number of chunks, ascending."""
    return (
        means.groupBy(F.col("n_chunks").alias("chunksize"))
        .agg(*[F.avg(name).alias(name) for name, _, _ in MEANS])
        .orderBy("chunksize")
    )


def metric_frame(means: DataFrame) -> DataFrame:
    """One row per (article, number of chunks), ordered by the number of chunks."""
    return means.select(
        F.col("n_chunks").alias("chunksize"), *[name for name, _, _ in MEANS]
    ).orderBy("chunksize")


def score_gap(means: DataFrame) -> DataFrame:
    """Mean ROUGE-1 F minus mean ROUGE-L F, a measure of consistency."""
    return means.withColumn("gap", F.col("meanf1_rouge1") - F.col("meanf1_rougeL"))


def score_report(scores: DataFrame, key: list[str], column: str = "scores") -> DataFrame:
    """Chunk-wise report with five decimals."""
    rows = pos_exploded(scores, key, F.col(column), "pos", "s")
    fields = [(m, f) for m in ("rouge1", "rougeL") for f in ("precision", "recall", "fmeasure")]
    return rows.select(
        *key,
        (F.col("pos") + 1).alias("chunk"),
        *[F.round(F.col("s")[m][f], 5).alias(f"{m}_{f}") for m, f in fields],
    )
