"""Mixing sources to target weights.

Tokens are aggregated per source, each source gets a target and from it a
repetition rate, and every document comes out floor(rate) times plus once more
with the fraction as probability, by a draw that its id and a seed decide.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from newsloom.llm.words import fresh, word_count
from newsloom.session import written


def ranked(keys: DataFrame, key: str) -> DataFrame:
    """Distinct keys with `_rank` from 0 in code point order, null last.

    Keys are sorted by range and numbered in their partition; what is summed
    over partitions is one count each, so no task sees all keys.
    """
    rows = keys.select(key).distinct()
    dealt = rows.repartitionByRange(F.col(key).asc_nulls_last()).sortWithinPartitions(F.col(key).asc_nulls_last())
    numbered = written(dealt.withColumn("_id", F.monotonically_increasing_id()), "mix-keys")
    numbered = numbered.select(
        key, F.shiftright("_id", 33).alias("_part"), F.col("_id").bitwiseAND((1 << 33) - 1).alias("_place")
    )
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = (
        numbered.groupBy("_part")
        .agg(F.count("*").alias("_n"))
        .select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    )
    return numbered.join(starts, "_part").select(key, (F.col("_start") + F.col("_place")).alias("_rank"))


def source_targets(
    sizes: DataFrame, source: str = "source", size: str = "size", weights: tuple[float, ...] = (1, 2, 3), most: float = 3.0
) -> DataFrame:
    """Per source: `source_size` and `target`, in the unit of `size`.

    Sources in code point order, null last, weigh `weights` in turn and share
    the whole of all sizes. A target stops at `most` times its source's size; the excess is
    shared anew by weight among the others until no target is above. A source
    without any size has target 0. Each round of the sharing reads three sums
    of the table of sources; every round but the last fixes a source at its limit.
    """
    totals = written(sizes.groupBy(source).agg(F.sum(size).cast("long").alias("source_size")), "mix-sources")
    right = ranked(totals, source).withColumnRenamed(source, "_key")
    turn = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("_rank") % len(weights) + 1).cast("int"))
    rows = written(
        totals.join(right, F.col(source).eqNullSafe(F.col("_key"))).select(
            source, "source_size", turn.alias("_weight"), (most * F.col("source_size")).alias("_limit")
        ),
        "mix-weights",
    )
    total = rows.agg(F.sum("source_size")).first()[0] or 0
    share, n_full = 0.0, -1  # what a weight of one gets; sources at their limit
    while True:
        full = F.col("_limit") <= share * F.col("_weight")
        at_limit, of_limit, open_weight = rows.agg(
            F.count(F.when(full, 1)), F.sum(F.when(full, F.col("_limit"))), F.sum(F.when(~full, F.col("_weight")))
        ).first()
        if at_limit == n_full or not open_weight:
            break
        n_full, share = at_limit, max(share, (total - (of_limit or 0.0)) / open_weight)
    target = F.least(F.col("_limit"), share * F.col("_weight"))
    return rows.select(source, "source_size", target.alias("target"))


def source_rates(docs: DataFrame, source: str, text: str, weights: tuple[float, ...], most: float) -> DataFrame:
    """`source_targets` of the documents, with `rate`; a source without any word has rate 0."""
    sizes = docs.select(F.col(source).alias("_source"), word_count(F.col(text)).alias("_size"))
    rate = F.least(F.col("target") / F.col("source_size"), F.lit(float(most)))
    return source_targets(sizes, "_source", "_size", weights, most).withColumn(
        "rate", F.when(F.col("source_size") > 0, rate).otherwise(0.0)
    )


def copies(key: Column, rate: Column, seed: int) -> Column:
    """floor(rate), plus one where the draw lies below the fraction of the rate.

    The draw is the first 52 bits of the MD5 digest of seed and key, as a
    number from 0 to 1; a null key draws as the text `null`.
    """
    digest = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit("null"))))
    draw = F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") / F.lit(float(1 << 52))
    return (F.floor(rate) + (draw < rate - F.floor(rate)).cast("long")).cast("long")


def mix(
    docs: DataFrame,
    source: str = "source",
    key: str = "doc_id",
    text: str = "text",
    seed: int = 20,
    weights: tuple[float, ...] = (1, 2, 3),
    most: float = 3.0,
    plan_only: bool = False,
) -> DataFrame:
    """The documents of the mix: every row as often as its rate and draw say, columns unchanged.

    A source's rate is target / source_size and at most `most`. With
    `plan_only` no row is repeated or left out; instead each is returned once,
    as `key`, `source`, `size`, `source_size`, `target` and `copies`.

    Equal keys draw alike, so repeated rows and reruns agree. Null texts and
    texts without words have size 0; in a source without any word the rate is
    0. A null source is a source of its own. An empty table gives no rows.
    Columns that bear the names used here are kept as they are.

    Texts are not shuffled where the table of sources is small enough for
    Spark to broadcast; where it is not, Spark's skew rule splits a hot source.
    """
    rates = source_rates(docs, source, text, weights, most)
    rate = F.struct(*[F.col(c) for c in rates.columns[1:]])
    found, held = fresh(docs, "_found"), fresh(docs, "_held")
    rates = rates.select(F.col("_source").alias(found), rate.alias(held))
    joined = docs.join(rates, docs[source].eqNullSafe(rates[found]))
    n = copies(docs[key], F.col(f"{held}.rate"), seed)
    if plan_only:
        return joined.select(
            docs[key],
            docs[source],
            word_count(docs[text]).alias("size"),
            f"{held}.source_size",
            f"{held}.target",
            n.alias("copies"),
        )
    again = F.explode(F.array_repeat(F.lit(0), n.cast("int"))).alias(found)
    return joined.select(*[docs[c] for c in docs.columns], again).drop(found)
