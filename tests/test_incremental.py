from datetime import datetime, timedelta

from conftest import plan_text
from pyspark.sql import functions as F

from newsloom.operators import incremental as I
from newsloom.operators.ingest import left_merge
from newsloom.sources import sinks

NOW = datetime(2024, 5, 2, 12)


def hours(n):
    return NOW - timedelta(hours=n)


def test_cut_dates(spark):
    targets = spark.createDataFrame([("e", c) for c in "abcd"], "entity string, category string")
    stored = spark.createDataFrame(
        [("e", "a", hours(23)), ("e", "a", hours(40)), ("e", "b", hours(24)), ("e", "c", hours(25)),
         ("e", "d", None)],
        "entity string, category string, publish_date timestamp_ntz",
    )
    rows = {r.category: r.cut_date for r in I.cut_dates(targets, stored, NOW).collect()}
    assert rows == {"a": hours(23), "b": hours(24), "c": hours(24), "d": hours(24)}
    other = I.cut_dates(targets, stored, NOW, floor="prev_midnight").collect()
    assert {r.category: r.cut_date for r in other}["c"] == hours(25)
    assert {r.category: r.cut_date for r in other}["d"] == datetime(2024, 5, 1)


def test_take_while_newer(spark):
    rows = spark.createDataFrame(
        [("a", 0, hours(1)), ("a", 1, None), ("a", 2, hours(2)), ("a", 3, hours(5)), ("a", 4, hours(1)),
         ("b", 0, hours(1)), ("b", 1, hours(3)), ("c", 0, hours(9))],
        "entity string, pos int, ts timestamp_ntz",
    )
    cuts = spark.createDataFrame(
        [("a", hours(4)), ("b", hours(3)), ("c", hours(4))], "entity string, cut_date timestamp_ntz"
    )
    got = I.take_while_newer(rows, cuts, ["entity"], "pos").collect()
    assert sorted((r.entity, r.pos) for r in got) == [("a", 0), ("a", 1), ("a", 2), ("b", 0)]


def test_lowest_dates(spark):
    rows = spark.createDataFrame(
        [("a", 0, hours(1)), ("a", 1, hours(3)), ("b", 0, None), ("b", 1, hours(-5)), ("c", 0, None)],
        "entity string, pos int, ts timestamp_ntz",
    )
    got = {r.entity: r.low_date for r in I.lowest_dates(rows, ["entity"], "pos", NOW).collect()}
    assert got == {"a": hours(3), "b": NOW, "c": NOW}


def test_first_per_key_limits_before_the_shuffle(spark):
    hot = spark.range(30_000).select(
        F.when(F.col("id") % 3 == 0, F.lit("hot")).otherwise(F.col("id").cast("string")).alias("k"),
        "id",
    )
    first = I.first_per_key(hot, "k", ["id"])
    plan = plan_text(first)
    assert plan.count("WindowGroupLimit") == 2 and "Partial" in plan
    rows = {r.k: r.id for r in first.collect()}
    assert rows["hot"] == 0 and len(rows) == 20_001


def test_left_merge(spark):
    listing = spark.createDataFrame([("x", 1), ("x", 2), ("y", 3)], "article_hash string, n int")
    bodies = spark.createDataFrame([("x", "b"), ("x", "c")], "article_hash string, article_body string")
    first = left_merge(listing, bodies, order=["article_body"]).collect()
    assert sorted((r.n, r.article_body or "-") for r in first) == [(1, "b"), (2, "b"), (3, "-")]
    got = left_merge(listing, bodies, multiply=True).collect()
    assert sorted((r.article_hash, r.n, r.article_body or "-") for r in got) == [
        ("x", 1, "b"), ("x", 1, "c"), ("x", 2, "b"), ("x", 2, "c"), ("y", 3, "-"),
    ]


def test_unseen_and_insert(spark, tmp_path):
    schema = "article_hash string, list_no int, pos int, publish_date timestamp_ntz"
    stored = spark.createDataFrame(
        [("old", 0, 0, hours(60)), ("new", 0, 1, hours(2)), ("undated", 0, 2, None)], schema
    )
    batch = spark.createDataFrame(
        [("old", 0, 0, hours(1)), ("new", 0, 1, hours(1)), ("undated", 0, 2, None), ("twice", 1, 0, None),
         ("twice", 0, 5, hours(1)), ("", 0, 6, None), (None, 0, 7, None)],
        schema,
    )
    seen = I.within_hours(stored, NOW)
    left = {r.article_hash for r in I.unseen(batch, seen).collect()}
    assert left == {"old", "undated", "twice", "", None}
    path = str(tmp_path / "table")
    sinks.append_rows(stored, path)
    for _ in range(2):  # a repeated batch adds nothing
        sinks.insert_if_absent(batch, path, "article_hash", ["list_no", "pos"])
    rows = spark.read.parquet(path).collect()
    assert sorted(r.article_hash for r in rows) == ["new", "old", "twice", "undated"]
    assert [(r.list_no, r.pos) for r in rows if r.article_hash == "twice"] == [(0, 5)]


def test_recapture(spark):
    rows = spark.createDataFrame(
        [("a", None, hours(72)), ("b", None, hours(71)), ("c", "x", hours(99))],
        "article_hash string, article_body string, capture_date timestamp_ntz",
    )
    assert [r.article_hash for r in I.recapture_due(rows, NOW).collect()] == ["a"]


def test_union_lists(spark):
    one = spark.createDataFrame([(1,), (1,)], "a int")
    got = I.union_lists(one, one).collect()
    assert sorted((r.a, r.list_no) for r in got) == [(1, 0), (1, 0), (1, 1), (1, 1)]
