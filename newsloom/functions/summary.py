"""Built-in extractive summaries of a chunk, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from newsloom.functions.rouge import tokens
from newsloom.functions.text import let, sentences, strip


def _candidates(chunk: Column) -> Column:
    """Stripped sentences of a chunk, blank ones left out."""
    return F.filter(F.transform(sentences(chunk), strip), lambda s: F.length(s) > 0)


def lead_sentence(chunk: Column) -> Column:
    """First sentence of a chunk; empty for an empty chunk."""
    return F.coalesce(F.get(_candidates(chunk), F.lit(0)), F.lit(""))


def central_sentence(chunk: Column) -> Column:
    """Sentence whose words are on average the most frequent in the chunk.

    The first one wins a tie. Counts are taken inside the chunk, which holds
    some 390 characters unless it is a single sentence, and a single sentence
    is its own summary.
    """

    def pick(options: Column) -> Column:
        def best(all_words: Column) -> Column:
            size = F.size(all_words)

            def rate(sentence: Column, i: Column) -> Column:
                def mean(own: Column) -> Column:
                    count = F.aggregate(
                        own,
                        F.lit(0),
                        lambda n, w: n + size - F.size(F.array_remove(all_words, w)),
                    )
                    return F.when(F.size(own) > 0, count / F.size(own)).otherwise(F.lit(0.0))

                return F.struct(
                    let(tokens(sentence), mean).alias("mean"), (-i).alias("order"), sentence.alias("text")
                )

            return F.array_max(F.transform(options, rate))["text"]

        several = let(tokens(F.array_join(options, " ")), best)
        return F.when(F.size(options) > 1, several).otherwise(
            F.coalesce(F.get(options, F.lit(0)), F.lit(""))
        )

    return let(_candidates(chunk), pick)


SUMMARISERS = {"lead": lead_sentence, "central": central_sentence}
