"""Numeric score functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def falsy_to_null(views: Column) -> Column:
    """Zero views count as unknown."""
    return F.nullif(views, F.lit(0))


def softmax_pair(negative: Column, positive: Column) -> Column:
    """Probabilities of two logits; the larger is subtracted first."""
    top = F.greatest(negative, positive)
    e_neg, e_pos = F.exp(negative - top), F.exp(positive - top)
    return F.struct(
        (e_neg / (e_neg + e_pos)).alias("negative"), (e_pos / (e_neg + e_pos)).alias("positive")
    )


def metric(overlap: Column, reference_size: Column, summary_size: Column) -> Column:
    """Precision, recall and F-measure of an overlap count."""
    precision = overlap / F.greatest(summary_size, F.lit(1))
    recall = overlap / F.greatest(reference_size, F.lit(1))
    both = precision + recall
    return F.struct(
        precision.alias("precision"),
        recall.alias("recall"),
        F.when(both > 0, 2 * precision * recall / both).otherwise(F.lit(0.0)).alias("fmeasure"),
    )
