"""Dictionary words, nearest words, word repair and lexicon scores."""

from __future__ import annotations

import os

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from newsloom.functions.arrays import exploded, pos_exploded
from newsloom.functions.scoring import softmax_pair
from newsloom.functions.text import (
    PLACE_NAME_RULES,
    let,
    letters_only,
    place_names,
    text_or_empty,
    words,
)
from newsloom.session import dealt_by, written

_STRINGS = "array<string>"


def spanish_stop_words() -> list[str]:
    """The Spanish list of Spark ML, as a file of this package: it needs no session."""
    path = os.path.join(os.path.dirname(os.path.dirname(__file__)), "data", "spanish_stop_words.txt")
    with open(path, encoding="utf-8") as file:
        return [w for w in file.read().split("\n") if w and not w.startswith("#")]


def space_parts(text: Column) -> Column:
    """Letters-only text between single spaces, without empty parts."""
    return F.filter(F.split(letters_only(text), " "), lambda p: F.length(p) > 0)


def word_places(items: Column) -> Column:
    """Each distinct word of an array once, with its places: (`word`, `places`).

    The words are sorted with their places, so equal ones stand in a row and
    the work stays close to linear in a long text.
    """

    def grouped(ordered: Column) -> Column:
        def cut(starts: Column) -> Column:
            return F.transform(
                starts,
                lambda at, k: F.struct(
                    F.element_at(ordered, at)["word"].alias("word"),
                    F.transform(
                        F.slice(ordered, at, F.coalesce(F.get(starts, k + 1), F.size(ordered) + 1) - at),
                        lambda x: x["place"],
                    ).alias("places"),
                ),
            )

        numbered = F.transform(
            ordered,
            lambda x, i: F.when((i == 0) | (x["word"] != F.element_at(ordered, F.greatest(i, F.lit(1)))["word"]), i + 1),
        )
        return let(F.filter(numbered, lambda at: at.isNotNull()), cut)

    places = F.transform(items, lambda w, i: F.struct(w.alias("word"), i.alias("place")))
    return let(F.array_sort(places), grouped)


def known_words(dictionary: DataFrame) -> DataFrame:
    """(`_known`): the distinct lower-case words of a dictionary."""
    return dictionary.select(F.lower("word").alias("_known")).distinct()


def unknown_words(df: DataFrame, key: list[str], words: Column, dictionary: DataFrame) -> DataFrame:
    """(key, unknown): the distinct words of each row that the dictionary lacks.

    Each distinct word of a row is looked up once. The join side is left to the
    planner: it broadcasts the dictionary when it measures it as small and else
    splits the frequent words (adaptive skew join).
    """
    looked_up = exploded(df, key, F.array_distinct(words), "_word")
    missing = looked_up.join(known_words(dictionary), F.lower("_word") == F.col("_known"), "left_anti")
    return missing.groupBy(*key).agg(F.collect_list("_word").alias("unknown"))


def rare_words(df: DataFrame, key: list[str], text: str, dictionary: DataFrame) -> DataFrame:
    """One row per occurrence of a word the dictionary lacks, with its position.

    A row's distinct words are looked up, each once with all its places; only
    those of unknown words become rows of their own.
    """
    each = exploded(df, key, word_places(space_parts(F.col(text))), "_w")
    missing = each.join(known_words(dictionary), F.lower("_w.word") == F.col("_known"), "left_anti")
    return missing.select(*key, F.explode("_w.places").alias("pos"), F.col("_w.word").alias("word"))


def nearest_word(word: Column, candidates: Column) -> Column:
    """Candidate at the smallest edit distance; the first of several wins.

    NULL without candidates. The comparison stays inside the row: no pair of
    words is ever a row of its own. A candidate is compared only if its length
    can beat the best so far, and only as far as it could.
    """
    start = F.struct(
        (F.length(word) + F.aggregate(candidates, F.lit(0), lambda n, c: F.greatest(n, F.length(c))) + 1).alias("d"),
        F.lit(None).cast("string").alias("word"),
    )

    def step(best: Column, c: Column) -> Column:
        def closer(d: Column) -> Column:
            return F.when(d >= 0, F.struct(d.alias("d"), c.alias("word"))).otherwise(best)

        able = F.abs(F.length(word) - F.length(c)) < best["d"]
        return F.when(able, let(F.call_function("levenshtein", word, c, best["d"] - 1), closer)).otherwise(best)

    return F.aggregate(candidates, start, step, lambda best: best["word"])


#: Letters of the longest word in the index; a longer word is compared directly.
INDEXED = 20
#: Candidates from which an index costs less than comparing them; the result is the same.
MANY = 100


def dropped_letters(word: Column, most: int = 2) -> Column:
    """The word and what is left of it without one and without two of its letters, each once.

    Two words at an edit distance of at most two share one of these.
    """
    out = F.array(word)
    for _ in range(most):
        shorter = F.transform(
            out,
            lambda w: F.transform(
                F.filter(F.sequence(F.lit(0), F.length(w)), lambda i: i > 0),
                lambda i: F.concat(F.substring(w, F.lit(1), i - 1), F.substring(w, i + 1, F.length(w))),
            ),
        )
        out = F.array_distinct(F.concat(out, F.flatten(shorter)))
    return out


def close_words(rows: DataFrame, key: list[str], asked: str, candidates: str) -> DataFrame:
    """(key, `close`): for asked words the nearest candidate of their row, as (word, nearest), if two edits or fewer away.

    The words meet on what is left of them without some letters, so a word is
    compared with the few candidates that share this and not with all. Words
    over `INDEXED` letters are left out.
    """
    pairs = rows.filter((F.size(asked) > 0) & (F.size(candidates) > 0))
    words = exploded(pairs, key, F.array_distinct(F.filter(asked, lambda w: F.length(w) <= INDEXED)), "word")
    words = exploded(words, [*key, "word"], dropped_letters(F.col("word")), "_rest")
    known = pos_exploded(pairs, [F.col(k).alias(f"_{k}") for k in key], F.col(candidates), "_at", "_candidate")
    known = known.filter(F.length("_candidate") <= INDEXED + 2)
    others = [f"_{k}" for k in key]
    known = exploded(known, [*others, "_at", "_candidate"], dropped_letters(F.col("_candidate")), "_left")
    same = F.col("_rest") == F.col("_left")
    for k, other in zip(key, others, strict=True):
        same = same & F.col(k).eqNullSafe(F.col(other))
    distance = F.levenshtein("word", "_candidate", 2)
    met = words.join(known, same).select(*key, "word", F.struct(distance.alias("d"), F.col("_at").alias("at"), F.col("_candidate").alias("candidate")).alias("c"))
    best = met.filter("c.d >= 0").groupBy(*key, "word").agg(F.min("c").alias("c"))
    return best.groupBy(*key).agg(F.collect_list(F.struct("word", F.col("c.candidate").alias("nearest"))).alias("close"))


def word_repairs(
    pairs: DataFrame, key: list[str], article: str, summary: str, dictionary: DataFrame
) -> DataFrame:
    """Adds `repairs` to each pair.

    `repairs` lists, in order and with repeats, every summary word that neither
    occurs inside the article (in any case) nor stands in the dictionary,
    together with the nearest rare word of the article. Each distinct word is
    compared once: inside the row, or, with `MANY` candidates or more, by an
    index first, which settles words up to two edits from a candidate.
    """
    parsed = dealt_by(pairs, *key).select(
        "*",
        letters_only(text_or_empty(F.col(article))).alias("_letters"),
        F.split(letters_only(text_or_empty(F.col(summary))), " ").alias("_tokens"),
    )
    foreign = let(
        F.lower("_letters"),
        lambda whole: F.filter("_tokens", lambda t: ~F.contains(whole, F.lower(t))),
    )
    parts = F.filter(F.split("_letters", " "), lambda p: F.length(p) > 0)
    parsed = parsed.withColumns({"_parts": parts, "_foreign": foreign})
    unknown = unknown_words(parsed, key, F.concat("_parts", "_foreign"), dictionary)
    joined = parsed.join(unknown, key, "left").withColumn(
        "unknown", F.coalesce("unknown", F.array().cast(_STRINGS))
    )
    # A part may hold line breaks; its pieces are the candidates, in order.
    candidates = F.array_distinct(
        F.flatten(F.transform(F.array_intersect("_parts", "unknown"), lambda p: words(p)))
    )
    strange = F.array_intersect("_foreign", "unknown")
    weird = let(strange, lambda s: F.filter("_foreign", lambda t: F.array_contains(s, t)))
    lists = joined.select(*pairs.columns, candidates.alias("_rare"), strange.alias("_asked"), weird.alias("_weird"))
    lists = written(lists, "word-repairs")
    close = close_words(lists.filter(F.size("_rare") >= MANY), key, "_asked", "_rare")
    others = [F.col(k).alias(f"_{k}") for k in key]
    same = F.lit(True)
    for k in key:
        same = same & F.col(k).eqNullSafe(F.col(f"_{k}"))
    found = lists.join(close.select(*others, "close"), same, "left").drop(*[f"_{k}" for k in key])
    none = F.array().cast("array<struct<word:string,nearest:string>>")
    settled = found.withColumn("close", F.coalesce("close", none))
    rest = F.array_except("_asked", F.transform("close", lambda x: x["word"]))
    far = F.transform(rest, lambda t: F.struct(t.alias("word"), nearest_word(t, F.col("_rare")).alias("nearest")))
    # The index and the rest together answer every distinct word.
    answer = lambda known, t: F.get(F.filter(known, lambda x: x["word"] == t), F.lit(0))["nearest"]
    repairs = let(
        F.concat("close", far),
        lambda known: F.transform("_weird", lambda t: F.struct(t.alias("word"), answer(known, t).alias("nearest"))),
    )
    return settled.withColumn("repairs", repairs).select(*pairs.columns, "repairs")


def repair_summaries(
    pairs: DataFrame,
    key: list[str],
    article: str,
    summary: str,
    dictionary: DataFrame,
    rules=PLACE_NAME_RULES,
) -> DataFrame:
    """Summaries with their unknown words replaced, then the place-name rules.

    Replacements run in word order on the whole text, each on the result of the
    one before. A word stays where the article has no rare words.
    """
    found = word_repairs(pairs, key, article, summary, dictionary)
    replaced = F.aggregate(
        "repairs",
        text_or_empty(F.col(summary)),
        lambda text, r: F.replace(text, r["word"], F.coalesce(r["nearest"], r["word"])),
    )
    return found.withColumn("repaired", place_names(replaced, rules))


def lexicon_logits(
    df: DataFrame, key: list[str], text: str, lexicon: DataFrame
) -> DataFrame:
    """Default sentiment logits: summed lexicon weights of the words of a text.

    `lexicon` has (word, negative, positive), one row per word. A text without
    lexicon words has logits 0. A text's distinct words are looked up, each
    once with the number of times it occurs. All words of a text lie in one input
    partition, so the sums are combined before the shuffle; the planner broadcasts a small
    lexicon and splits frequent words of a large one.
    """
    each = exploded(df, key, word_places(words(letters_only(F.lower(text)))), "_w")
    times = F.size("_w.places")
    logits = (
        each.join(lexicon, F.col("_w.word") == F.col("word"))
        .groupBy(*key)
        .agg(F.sum(F.col("negative") * times).alias("logit_neg"), F.sum(F.col("positive") * times).alias("logit_pos"))
    )
    return (
        df.select(*key)
        .join(logits, key, "left")
        .select(
            *key,
            F.coalesce("logit_neg", F.lit(0.0)).alias("logit_neg"),
            F.coalesce("logit_pos", F.lit(0.0)).alias("logit_pos"),
        )
    )


def sentiment(logits: DataFrame) -> DataFrame:
    """Negative and positive probability from two logits per row."""
    p = softmax_pair(F.col("logit_neg"), F.col("logit_pos"))
    return logits.withColumn("_p", p).select(
        *logits.columns, F.col("_p.negative").alias("negative"), F.col("_p.positive").alias("positive")
    )


__all__ = [
    "lexicon_logits",
    "nearest_word",
    "rare_words",
    "repair_summaries",
    "sentiment",
    "space_parts",
    "spanish_stop_words",
    "unknown_words",
    "word_repairs",
]
