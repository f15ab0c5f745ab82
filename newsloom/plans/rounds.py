"""Chunk, summarise, chunk the summaries again, until fewer than five are left."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from newsloom.functions.arrays import exploded
from newsloom.functions.text import CHUNK_CHARS, greedy_chunks, let, sentences
from newsloom.operators.evaluation import add_scores
from newsloom.operators.summarise import model_summaries, summarise_chunks
from newsloom.session import checkpoint, dealt

# Fixed value: re-chunking ends when fewer chunks than this are left.
ENOUGH_CHUNKS = 5

_ROUNDS = "array<struct<round:int,chunks:array<string>,summaries:array<string>>>"


def all_rounds(body: Column, method: str = "central", size: int = CHUNK_CHARS) -> Column:
    """Every round of an article as an array, in one expression without a shuffle.

    A round is recorded before its exit test. An extractive round either joins
    sentences, leaving fewer of them, or changes nothing more; in the second
    case it would repeat for ever, so it ends there. The number of sentences
    therefore bounds the rounds, and no round is cut off.
    """
    first = greedy_chunks(sentences(body), size)

    def run(start: Column) -> Column:
        state = F.struct(
            start.alias("chunks"),
            F.array().cast(_ROUNDS).alias("rounds"),
            (F.size(start) == 0).alias("done"),
        )

        def step(s: Column, i: Column) -> Column:
            def advance(summaries: Column) -> Column:
                return let(
                    greedy_chunks(summaries, size),
                    lambda chunks: F.struct(
                        chunks.alias("chunks"),
                        F.concat(
                            s["rounds"],
                            F.array(
                                F.struct(
                                    i.alias("round"),
                                    s["chunks"].alias("chunks"),
                                    summaries.alias("summaries"),
                                )
                            ),
                        ).alias("rounds"),
                        ((F.size(chunks) < ENOUGH_CHUNKS) | (chunks == s["chunks"])).alias("done"),
                    ),
                )

            return F.when(s["done"], s).otherwise(
                let(summarise_chunks(s["chunks"], method), advance)
            )

        # Summaries are single sentences, at most one per part and never split
        # again: this many steps always reach the resting state.
        steps = F.sequence(F.lit(1), F.size(sentences(body)) + 4)
        return F.aggregate(steps, state, step, lambda s: s["rounds"])

    return let(first, run)


def rechunk_rounds(
    articles: DataFrame,
    key: list[str],
    body: str = "article_body",
    method: str = "central",
    size: int = CHUNK_CHARS,
) -> DataFrame:
    """(key, rounds) per article with the built-in summaries.

    The texts are dealt first: the rounds cost far more than moving a text once.
    """
    return dealt(articles.select(*key, body)).select(
        *key, all_rounds(F.col(body), method, size).alias("rounds")
    )


def one_row_per_round(rounds: DataFrame) -> DataFrame:
    keep = [c for c in rounds.columns if c != "rounds"]
    return exploded(rounds, keep, F.col("rounds"), "r").select(
        *keep, "r.round", F.size("r.chunks").alias("n_chunks"), "r.chunks", "r.summaries"
    )


def rechunk_with_model(
    articles: DataFrame,
    key: list[str],
    load_model: Callable,
    body: str = "article_body",
    size: int = CHUNK_CHARS,
) -> DataFrame:
    """The same loop with a pluggable model: one Spark job per round.

    Each round scores the articles still open and is checkpointed, so a lost
    executor never repeats a model call of an earlier round. An article is
    finished with fewer than five chunks left, with the same chunks again, or
    with summaries that together are no shorter than their chunks. So the
    length falls from round to round, and the loop ends by itself.
    """
    chunks = greedy_chunks(sentences(F.col(body)), size)
    active = articles.select(*key, body).select(*key, chunks.alias("chunks"))
    active = active.filter(F.size("chunks") > 0)
    recorded, number = [], 0
    length = lambda texts: F.aggregate(texts, F.lit(0), lambda n, t: n + F.length(t))
    while number == 0 or not active.isEmpty():
        number += 1
        scored = active.withColumn("summaries", model_summaries(F.col("chunks"), load_model))
        scored = scored.withColumn("_next", greedy_chunks(F.col("summaries"), size))
        scored = checkpoint(
            scored.withColumn(
                "finished",
                (F.size("_next") < ENOUGH_CHUNKS)
                | (F.col("_next") == F.col("chunks"))
                | (length(F.col("summaries")) >= length(F.col("chunks"))),
            )
        )
        recorded.append(
            scored.select(
                *key,
                F.lit(number).alias("round"),
                F.size("chunks").alias("n_chunks"),
                "chunks",
                "summaries",
                "finished",
            )
        )
        active = scored.filter(~F.col("finished")).select(*key, F.col("_next").alias("chunks"))
    return reduce(DataFrame.unionByName, recorded)


def score_rounds(rounds: DataFrame, stem: bool = True, metrics: tuple[str, ...] = ("rouge1", "rougeL")) -> DataFrame:
    """ROUGE of each summary against its chunk, per row of chunks and summaries."""
    return add_scores(rounds, "chunks", "summaries", stem, metrics)


def last_per_chunk_count(rounds: Column) -> Column:
    """Of rounds with equally many chunks only the last is kept."""
    return F.filter(
        rounds,
        lambda r: ~F.exists(
            rounds,
            lambda later: (F.size(later["chunks"]) == F.size(r["chunks"]))
            & (later["round"] > r["round"]),
        ),
    )


def experiment(rounds: DataFrame, stem: bool = True) -> DataFrame:
    """One row per (article, number of chunks), scored; later rounds replace earlier ones."""
    kept = rounds.withColumn("rounds", last_per_chunk_count(F.col("rounds")))
    return score_rounds(one_row_per_round(kept), stem)


def round_changes(means: DataFrame, key: list[str], value: str = "meanf1_rouge1") -> DataFrame:
    """Change of a score from one round of an article to the next.

    The rounds of one article are few, so they are compared inside a row.
    """
    ordered = F.array_sort(F.collect_list(F.struct("round", "n_chunks", F.col(value).alias("v"))))
    series = means.groupBy(*key).agg(ordered.alias("s"))
    pairs = F.transform(
        "s",
        lambda x, i: F.struct(
            x["round"].alias("round"),
            x["n_chunks"].alias("n_chunks"),
            x["v"].alias("value"),
            (x["v"] - F.get("s", i - 1)["v"]).alias("change"),
        ),
    )
    return exploded(series, key, pairs, "p").select(*key, "p.*")
