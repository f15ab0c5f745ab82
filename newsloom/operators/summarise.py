"""Summaries and scores from built-in or pluggable models."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from newsloom.functions.summary import SUMMARISERS
from newsloom.functions.text import MAX_BULLETS, MAX_WORDS, strip, words

TextModel = Callable[[list[str]], list[str]]
LogitModel = Callable[[list[str]], list[tuple[float, float]]]


def summarise_chunks(chunks: Column, method: str = "central") -> Column:
    """Extractive summary of each chunk of an array, inside the JVM."""
    return F.transform(chunks, SUMMARISERS[method])


def model_summaries(chunks: Column, load_model: Callable[[], TextModel]) -> Column:
    """Summaries of an array of chunks by a model.

    `load_model` runs once per task; the model gets all the chunks of an Arrow
    batch at once.
    """

    @F.pandas_udf(T.ArrayType(T.StringType()))
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = load_model()
        for batch in batches:
            sizes = [0 if c is None else len(c) for c in batch]
            flat = [text for c in batch if c is not None for text in c]
            results = iter(model(flat) if flat else [])
            yield pd.Series([[next(results) for _ in range(n)] for n in sizes])

    return score(chunks)


def model_logits(
    df: DataFrame, key: list[str], text: str, load_model: Callable[[], LogitModel]
) -> DataFrame:
    """Two sentiment logits per text by a model, loaded once per task."""
    schema = T.StructType(
        [df.schema[k] for k in key]
        + [T.StructField("logit_neg", T.DoubleType()), T.StructField("logit_pos", T.DoubleType())]
    )

    def score(batches):
        model = load_model()
        for batch in batches:
            pairs = model(batch[text].tolist()) if len(batch) else []
            yield batch[key].assign(
                logit_neg=[float(a) for a, _ in pairs], logit_pos=[float(b) for _, b in pairs]
            )

    return df.select(*key, text).mapInPandas(score, schema)


def summary_checks(df: DataFrame, summary: str = "summary") -> DataFrame:
    """Counts the rules of a generated summary: a title line, then bullets."""
    lines = F.filter(F.split(summary, "\n"), lambda line: F.length(strip(line)) > 0)
    count = F.size(words(F.col(summary)))
    return (
        df.withColumn("n_bullets", F.greatest(F.size(lines) - 1, F.lit(0)))
        .withColumn("n_words", count)
        .withColumn(
            "is_valid", (F.col("n_bullets") <= MAX_BULLETS) & (F.col("n_words") <= MAX_WORDS)
        )
    )
