"""The learned decision list against a plain sequential covering."""

import math
import random

from pyspark.sql import functions as F

from newsloom.llm import quality


def covered(rule, row):
    return all((row[c.feature] > c.threshold) == c.above for c in rule)


def slow_rules(rows, cuts, least_precision):
    rules, left = [], rows
    while True:
        rule = ()
        while True:
            inside = [r for r in left if not r["_prune"] and covered(rule, r)]
            bad = sum(r["_bad"] for r in inside)
            best, most = None, 1e-9
            for name, values in cuts.items():
                for value in values:
                    for above in (False, True):
                        condition = quality.Condition(name, above, value)
                        hit = [r["_bad"] for r in inside if covered((condition,), r)]
                        if 0 < bad < len(inside) and sum(hit):
                            gain = sum(hit) * (math.log(sum(hit) / len(hit)) - math.log(bad / len(inside)))
                            if gain > most:
                                best, most = condition, gain
            if best is None:
                break
            rule += (best,)
        tests, worth = [r for r in left if r["_prune"]], []
        for k in range(1, len(rule) + 1):
            hit = [r["_bad"] for r in tests if covered(rule[:k], r)]
            worth.append(((2 * sum(hit) - len(hit)) / len(hit) if hit else -1.0, -k, sum(hit), len(hit)))
        _, k, p, n = max(worth, default=(0, 0, 0, 0))
        if not p or p / n < least_precision:
            return rules
        rules.append(rule[:-k])
        left = [r for r in left if not covered(rules[-1], r)]


def labelled(spark, seed, n=600):
    """Bad rows in several boxes, so that lists of several rules with several conditions come out."""
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        a, b, c = (round(rng.random(), 2) for _ in range(3))
        bad = a > 0.8 or (b > 0.6 and c <= 0.4) or (a <= 0.1 and c > 0.7)
        rows.append((int(bad), i % 3 == 0, a, b, c))
    return spark.createDataFrame(rows, "_bad long, _prune boolean, a double, b double, c double")


def test_rules_are_those_of_plain_covering(spark):
    for seed in (1, 2):
        frame = labelled(spark, seed)
        cuts = quality.thresholds_of(frame, ["a", "b", "c"], 16)
        want = slow_rules([r.asDict() for r in frame.collect()], cuts, 0.9)
        assert len(want) > 1 and max(map(len, want)) > 1
        assert quality.learn_rules(frame, 16, 0.9) == want


def test_list_is_as_long_as_the_labels_need(spark):
    """Fifteen values of one feature mark bad rows, each with a rule of its own."""
    rows = [(int(v % 2 == 1), k == 0, float(v)) for v in range(1, 31) for k in range(3 if v % 2 else 4)]
    frame = spark.createDataFrame(rows, "_bad long, _prune boolean, a double")
    rules = quality.learn_rules(frame, 64, 0.95)
    assert len(rules) > 12
    verdict = quality.decision_list(rules, {"a": F.col("a")}).isNotNull()
    assert {r["a"]: r["bad"] for r in frame.select("a", verdict.alias("bad")).distinct().collect()} == {float(v): v % 2 == 1 for v in range(1, 31)}


def test_no_rules_without_both_labels(spark):
    frame = labelled(spark, 3, 60)
    for rows in (frame.filter("_bad = 0"), frame.filter("_bad = 1"), frame.limit(0)):
        assert quality.learn_rules(rows) == []
