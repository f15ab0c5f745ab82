"""Quality rules: text statistics and a decision list learned from labels.

Everything is column expressions and groupings: statistics are array functions
over a row's own words and lines, and the list is learned by sequential
covering from counts per (statistic, bin), a few hundred rows per step.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from newsloom.functions.text import let
from newsloom.llm.words import BLANKS, fresh, word_array
from newsloom.session import written

SYMBOLS = "#*$%&|<>"
WINDOW = 5


def chars_in(text: Column, letters: str) -> Column:
    """How many characters of the text are among `letters`."""
    return (F.length(text) - F.length(F.translate(text, letters, ""))).cast("long")


def duplicate_lines(text: Column) -> Column:
    """Lines with a word that equal an earlier line."""
    lines = F.filter(F.split(text, "\n"), lambda x: F.length(F.translate(x, BLANKS, "")) > 0)
    return let(lines, lambda x: (F.size(x) - F.size(F.array_distinct(x))).cast("long"))


def repeated_words(words: Column, width: int = WINDOW) -> Column:
    """Words inside windows of `width` words that occur at least twice among these words.

    Windows are hashed; only a text with a repeated hash is sorted. Its
    repeated windows' places in order then cover min(width, distance to the
    next place) words each.
    """
    places = F.sequence(F.lit(1), F.size(words) - (width - 1))
    hashes = F.transform(places, lambda i: F.xxhash64(F.slice(words, i, width)))

    def covered(at: Column) -> Column:
        steps = F.transform(at, lambda p, i: F.coalesce(F.least(F.get(at, i + 1) - p, F.lit(width)), F.lit(width)))
        return F.aggregate(steps, F.lit(0).cast("long"), lambda a, x: a + x)

    def repeats(pairs: Column) -> Column:
        same = lambda x, i: (F.get(pairs, i - 1)["h"] == x["h"]) | (F.get(pairs, i + 1)["h"] == x["h"])
        at = F.transform(pairs, lambda x, i: F.when(same(x, i), x["p"]))
        return let(F.sort_array(F.filter(at, lambda p: p.isNotNull())), covered)

    def count(h: Column) -> Column:
        pairs = F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("p"))))
        return F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0).cast("long")).otherwise(let(pairs, repeats))

    return F.when(F.size(words) < width + 1, F.lit(0).cast("long")).otherwise(let(hashes, count))


def statistics(text: Column) -> Column:
    """A struct of counts over the whole text; null counts as empty.

    `n_words`, `word_chars` (code points in words), `n_symbols` (of
    `#*$%&|<>`), `n_dup_lines`, `n_repeat_words`, and for the rules
    `n_upper`, `n_digits`, `n_marks` (`!` and `?`).
    """

    def of(t: Column) -> Column:
        def counts(w: Column) -> Column:
            return F.struct(
                F.size(w).cast("long").alias("n_words"),
                F.length(F.translate(t, BLANKS, "")).cast("long").alias("word_chars"),
                chars_in(t, SYMBOLS).alias("n_symbols"),
                duplicate_lines(t).alias("n_dup_lines"),
                repeated_words(w).alias("n_repeat_words"),
                F.length(F.regexp_replace(t, r"\P{Lu}+", "")).cast("long").alias("n_upper"),
                chars_in(t, "0123456789").alias("n_digits"),
                chars_in(t, "!?").alias("n_marks"),
            )

        return let(word_array(t), counts)

    return let(F.coalesce(text, F.lit("")), of)


def features(s: Column) -> dict[str, Column]:
    """What rules may put a threshold on; 0 everywhere for a text without words.

    All are shares that do not move with the length of a text by themselves,
    so a rule learned on short texts means the same on long ones.
    """
    words = F.greatest(s["n_words"], F.lit(1))
    chars = F.greatest(s["word_chars"], F.lit(1))
    return {
        "symbols_per_word": s["n_symbols"] / words,
        "upper_share": s["n_upper"] / chars,
        "digit_share": s["n_digits"] / chars,
        "marks_per_word": s["n_marks"] / words,
        "dup_lines_per_word": s["n_dup_lines"] / words,
        "repeat_share": s["n_repeat_words"] / words,
        "chars_per_word": s["word_chars"] / words,
    }


def base_failed(s: Column) -> Column:
    """Fewer than 10 words, or over 20 % of them in repeated windows."""
    return (s["n_words"] < 10) | (100 * s["n_repeat_words"] > 20 * s["n_words"])


@dataclass(frozen=True)
class Condition:
    """`feature > threshold`, or `feature <= threshold` where not above."""

    feature: str
    above: bool
    threshold: float

    def holds(self, values: dict[str, Column]) -> Column:
        value = values[self.feature]
        return value > self.threshold if self.above else value <= self.threshold

    def __str__(self) -> str:
        return f"{self.feature} {'>' if self.above else '<='} {self.threshold:.6g}"


Rule = tuple[Condition, ...]


def holds(rule: Rule, values: dict[str, Column]) -> Column:
    out = F.lit(True)
    for condition in rule:
        out = out & condition.holds(values)
    return out


def decision_list(rules: list[Rule], values: dict[str, Column]) -> Column:
    """The text of the first rule that holds, as one conditional expression; null where none does."""
    out = F.lit(None).cast("string")
    for rule in reversed(rules):
        out = F.when(holds(rule, values), F.lit(" and ".join(map(str, rule)))).otherwise(out)
    return out


def judgement(text: Column, rules: list[Rule]) -> Column:
    """`statistics`, `base_failed`, `rule` and `kept` in one struct, so the statistics are computed once per row."""

    def of(s: Column) -> Column:
        def verdict(rule: Column) -> Column:
            kept = ~base_failed(s) & rule.isNull()
            return F.struct(s.alias("statistics"), base_failed(s).alias("base_failed"), rule.alias("rule"), kept.alias("kept"))

        return let(decision_list(rules, features(s)), verdict)

    return let(statistics(text), of)


def labelled_features(docs: DataFrame, labels: DataFrame, label: str, text: str, most_rows: int, seed: int) -> DataFrame:
    """Features and `_bad` of about `most_rows` labelled documents at most, one row for each id.

    Labels are thinned by a hash of the id to the bound, which is what bounds
    the broadcast: so many ids and no more, however often an id has a label. Of
    several labels of an id the least counts, and of several texts the longest.
    """
    known = labels.filter(F.col(label).isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.min(label).alias(label))
    share = min(1.0, most_rows / max(known.count(), 1))
    draw = F.shiftrightunsigned(F.xxhash64(F.lit(seed), "doc_id"), 11) / F.lit(float(1 << 53))
    chosen = known.filter(draw < share).select(
        F.col("doc_id").alias("_labelled"), (F.col(label) == 0).cast("long").alias("_bad"), (draw * 3 / share > 2).alias("_prune")
    )
    rows = docs.select("doc_id", F.col(text).alias("_text")).join(F.broadcast(chosen), F.col("doc_id") == F.col("_labelled"))
    # Copies of an id combine in each task before the few rows are shuffled.
    longest = F.max(F.struct(F.length("_text").alias("n"), F.col("_text").alias("text"))).alias("_best")
    rows = rows.groupBy("doc_id", "_bad", "_prune").agg(longest)
    rows = rows.select("_bad", "_prune", statistics(F.col("_best.text")).alias("_s"))
    return written(rows.select("_bad", "_prune", *[c.alias(k) for k, c in features(F.col("_s")).items()]), "quality-labelled")


def thresholds_of(rows: DataFrame, names: list[str], n: int) -> dict[str, list[float]]:
    """Up to 2n cut values per feature: quantiles of the bad rows and of the others."""
    steps = [i / n for i in range(n + 1)]
    cuts = lambda bad, c: F.percentile_approx(F.when(F.col("_bad") == bad, F.col(c)), steps, 1_000_000)
    row = rows.agg(*[cuts(bad, c).alias(f"{c}{bad}") for c in names for bad in (0, 1)]).first()
    return {c: sorted({*(row[f"{c}0"] or []), *(row[f"{c}1"] or [])}) for c in names}


def bin_of(value: Column, cuts: list[float]) -> Column:
    """How many cuts lie below the value."""
    return F.size(F.filter(F.array(*map(F.lit, cuts)).cast("array<double>"), lambda t: t < value))


def learn_rules(rows: DataFrame, n_cuts: int = 32, least_precision: float = 0.95) -> list[Rule]:
    """Rules for the rows with `_bad` = 1, in the order they were found.

    Two thirds of the rows grow a rule: the condition with the highest
    information gain over counts per (feature, bin) is added until no good row
    is left or nothing is gained. The other third (`_prune`) cuts it back to
    the start that is worth most there. A rule is taken if at least
    `least_precision` of the pruning rows it covers are bad; covered rows are
    then set aside, and covering ends with the first rule that is not taken. A
    rule covers a bad pruning row at least, so their number bounds the list. Each
    step groups the labelled rows and brings at most features x bins counts to the driver.
    """
    names = [c for c in rows.columns if not c.startswith("_")]
    cuts = thresholds_of(rows, names, n_cuts)
    bins = [bin_of(F.col(c), cuts[c]).alias(c) for c in names]
    binned = written(rows.select("*", F.array(*bins).alias("_bins")), "quality-bins")
    values = {c: F.col(c) for c in names}
    left, rules = binned, []
    while True:
        rule = grow(left.filter(~F.col("_prune")), names, cuts, values)
        rule = prune(left.filter("_prune"), rule, values, least_precision)
        if not rule:
            return rules
        rules.append(rule)
        left = left.filter(~holds(rule, values))


def grow(rows: DataFrame, names: list[str], cuts: dict, values: dict[str, Column]) -> Rule:
    """Conditions as long as one gains: each raises the share of bad rows, so each leaves out a good one."""
    rule: Rule = ()
    while True:
        pairs = rows.filter(holds(rule, values)).select("_bad", F.posexplode("_bins").alias("f", "b"))
        counts = pairs.groupBy("f", "b").agg(F.sum("_bad").alias("p"), F.sum(1 - F.col("_bad")).alias("n")).collect()
        best = best_condition(counts, names, cuts)
        if best is None:
            return rule
        rule += (best,)


def best_condition(counts: list, names: list[str], cuts: dict) -> Condition | None:
    """The condition with the highest gain p * (log p/(p+n) - log P/(P+N)); ties go to the first."""
    by: dict[int, dict[int, tuple[int, int]]] = {}
    for r in counts:
        by.setdefault(r["f"], {})[r["b"]] = (r["p"], r["n"])
    best, most = None, 1e-9
    for f in sorted(by):
        total_p, total_n = (sum(x[k] for x in by[f].values()) for k in (0, 1))
        if not total_p or not total_n:
            return None
        below_p = below_n = 0
        for b, cut in enumerate(cuts[names[f]]):
            p, n = by[f].get(b, (0, 0))
            below_p, below_n = below_p + p, below_n + n
            for above, hit, miss in ((False, below_p, below_n), (True, total_p - below_p, total_n - below_n)):
                if hit and (gain := hit * (math.log(hit / (hit + miss)) - math.log(total_p / (total_p + total_n)))) > most:
                    best, most = Condition(names[f], above, cut), gain
    return best


def prune(rows: DataFrame, rule: Rule, values: dict[str, Column], least_precision: float) -> Rule:
    """The start of the rule with the highest (p - n) / (p + n) here, the shorter of equals; none below the precision."""
    starts = [rule[:k] for k in range(1, len(rule) + 1)]
    if not starts:
        return ()
    sums = [F.sum(F.when(holds(s, values), x)) for s in starts for x in (F.col("_bad"), 1 - F.col("_bad"))]
    got = [x or 0 for x in rows.agg(*[c.alias(f"c{i}") for i, c in enumerate(sums)]).first()]
    worth = [(p - n) / (p + n) if p + n else -1.0 for p, n in zip(got[::2], got[1::2], strict=True)]
    k = max(range(len(starts)), key=lambda i: (worth[i], -i))
    p, n = got[2 * k : 2 * k + 2]
    return starts[k] if p and p / (p + n) >= least_precision else ()


def judged(
    docs: DataFrame,
    labels: DataFrame,
    text: str = "text",
    label: str = "quality",
    most_rows: int = 20_000,
    seed: int = 10,
    **options,
) -> DataFrame:
    """All columns of `docs` and a struct `judgement` of `statistics`, `base_failed`, `rule`, `kept`.

    Rules are learned from at most about `most_rows` labelled rows (label 0 is
    bad), thinned by a hash of the id. `rule` names the first that holds, null
    for none; `kept` is false where the base test fails or a rule holds. Null
    texts count as empty and fail the base test. Without labels of both kinds
    there are no rules. Of several labels of one id the least counts, of several
    texts the longest. The list ends by gain and precision alone. Repeated rows
    and texts of any length are judged each by itself; an empty table gives no
    rows. Where `docs` has a column of that name, the new one gets underscores in
    front (see `words.fresh`); it is the last column.
    """
    rules = learn_rules(labelled_features(docs, labels, label, text, most_rows, seed), **options)
    return docs.withColumn(fresh(docs, "judgement"), judgement(F.col(text), rules))
