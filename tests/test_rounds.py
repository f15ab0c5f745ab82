import random

import pytest
from pyspark.sql import functions as F

from newsloom.functions.summary import central_sentence
from newsloom.functions.text import greedy_chunks
from newsloom.operators import evaluation as E
from newsloom.plans import rounds as L


@pytest.fixture(scope="module")
def bodies():
    rng = random.Random(11)
    word = lambda: "".join(rng.choice("abcdefg") for _ in range(rng.randint(1, 9)))
    sentence = lambda: " ".join(word() for _ in range(rng.randint(1, 14)))
    texts = [". ".join(sentence() for _ in range(rng.randint(1, 90))) + "." for _ in range(60)]
    texts.append(".".join("z" * 500 for _ in range(9)))  # never gets fewer chunks
    texts += ["", "one", ". . .", "q" * 400 + ".a.b.c.d.e"]
    return texts


def frame(spark, bodies):
    return spark.createDataFrame([(i, b) for i, b in enumerate(bodies)], "id int, article_body string")


@pytest.mark.parametrize("size", [40, 390])
def test_each_round_follows_from_the_one_before(spark, bodies, size):
    df = L.rechunk_rounds(frame(spark, bodies), ["id"], method="lead", size=size)
    again = greedy_chunks(F.col("r.summaries"), size)
    rows = df.select("id", F.posexplode("rounds").alias("n", "r")).select("id", "n", "r.*", again.alias("next"))
    got = {}
    for r in rows.orderBy("id", "n").collect():
        assert len(r.summaries) == len(r.chunks) and r.round == r.n + 1
        assert all(s in c for s, c in zip(r.summaries, r.chunks))
        got.setdefault(r.id, []).append(r)
    for series in got.values():
        for one, two in zip(series, series[1:]):
            assert two.chunks == one.next and len(one.next) >= 5 and one.next != one.chunks
        assert len(series[-1].next) < 5 or series[-1].next == series[-1].chunks
    assert max(map(len, got.values())) > (2 if size < 390 else 0)


def test_rounds_of_a_written_out_article(spark):
    body = "aa bb. cc dd. ee. ff gg hh. ii. jj kk. ll. mm nn oo. pp. qq rr"
    got = L.rechunk_rounds(frame(spark, [body, "." * 600]), ["id"], method="lead", size=8).collect()
    assert [r.rounds for r in got if r.id == 1] == [[]]
    rounds = next(r.rounds for r in got if r.id == 0)
    assert rounds[0].chunks == ["aa bb", "cc dd. ee", "ff gg hh", "ii. jj kk", "ll", "mm nn oo", "pp. qq rr"]
    assert rounds[0].summaries[0] == "aa bb"


def test_rounds_with_a_model_equal_native(spark, bodies):
    def load():
        def summarise(texts):
            return [next((s.strip() for s in t.split(".") if s.strip()), "") for t in texts]

        return summarise

    df = frame(spark, bodies)
    driven = L.rechunk_with_model(df, ["id"], load, size=60)
    native = L.one_row_per_round(L.rechunk_rounds(df, ["id"], method="lead", size=60))
    key = lambda r: (r.id, r.round, r.n_chunks, tuple(r.chunks), tuple(r.summaries))
    assert sorted(map(key, driven.collect())) == sorted(map(key, native.collect()))


def test_a_model_that_shrinks_slowly_finishes(spark):
    def load():
        return lambda texts: [t[:-1] if len(t) > 40 else t for t in texts]

    body = ".".join("z" * 75 for _ in range(6))
    rows = L.rechunk_with_model(frame(spark, [body]), ["id"], load, size=20).orderBy("round").collect()
    assert len(rows) > 20
    assert [r.finished for r in rows] == [False] * (len(rows) - 1) + [True]


def test_central_sentence(spark):
    texts = ["a b. a a. c", "x y. x y", "", "solo una", " . uno. "]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, v string")
    got = [r[0] for r in df.orderBy("i").select(central_sentence(F.col("v"))).collect()]
    assert got == ["a a", "x y", "", "solo una", "uno"]


def test_later_round_replaces_equal_count(spark):
    rows = [
        (1, [(1, ["a", "b"], ["x", "y"]), (2, ["c", "d"], ["z", "w"]), (3, ["e"], ["e"])]),
    ]
    schema = "id int, rounds array<struct<round:int,chunks:array<string>,summaries:array<string>>>"
    df = spark.createDataFrame(rows, schema)
    got = L.experiment(df).orderBy("round").collect()
    assert [(r.round, r.n_chunks, r.summaries) for r in got] == [(2, 2, ["z", "w"]), (3, 1, ["e"])]
    assert got[1].scores[0].rougeL.fmeasure == 1.0


def test_means_and_changes(spark):
    score = lambda v: ((v, v, v), (v / 2, v / 2, v / 2))
    rows = [(1, 1, 2, [score(0.5), score(1.0)]), (1, 2, 1, [score(0.25)])]
    metric = "struct<precision:double,recall:double,fmeasure:double>"
    df = spark.createDataFrame(
        rows, f"id int, round int, n_chunks int, scores array<struct<rouge1:{metric},rougeL:{metric}>>"
    )
    means = E.score_means(df)
    first = means.orderBy("round").first()
    assert (first.meanf1_rouge1, first.meanrecall_rougeL) == (0.75, 0.375)
    changes = L.round_changes(means, ["id"]).orderBy("round").collect()
    assert [r.change for r in changes] == [None, -0.5]
    assert [r.gap for r in E.score_gap(means).orderBy("round").collect()] == [0.375, 0.125]
    assert [r.chunksize for r in E.means_by_chunks(means).collect()] == [1, 2]
    assert [r.chunksize for r in E.metric_frame(means).collect()] == [1, 2]
    report = E.score_report(df, ["id", "round"]).collect()
    assert len(report) == 3 and report[0].rouge1_precision == 0.5


def test_expression_is_computed_once(spark, bodies):
    """The planner must not add a filter that repeats the costly fold."""
    from conftest import plan_text

    df = L.one_row_per_round(L.rechunk_rounds(frame(spark, bodies), ["id"]))
    assert plan_text(df).count("AS rounds#") == 1

