from datetime import datetime

import pytest
from pyspark.sql import functions as F

from newsloom import schema as S
from newsloom.operators import profile as P
from newsloom.operators import quality as Q
from newsloom.operators import ranking as R
from newsloom.session import scratch_path, shared_dir
from newsloom.sources import files, sinks

ROWS = [
    {"article_hash": "1", "article_title": 'semi;colon "quoted"', "article_body": "line\nbreak;\r\n  pad  ",
     "publish_date": datetime(2024, 1, 1, 2, 3, 4)},
    {"article_hash": "2", "article_title": "", "article_body": None, "negative_score": 0.25},
    {"article_hash": "3", "article_title": '"', "article_body": 'a""b\\'},
]


@pytest.fixture
def rows(spark):
    return files.rows_with_schema(spark, ROWS, S.LISTING_EXPORT)


@pytest.mark.parametrize("single", [True, False])
def test_csv_round_trip(spark, rows, tmp_path, single):
    path = str(tmp_path / "csv")
    sinks.write_csv(rows, path, single_file=single)
    back = files.read_articles_csv(spark, path)
    assert sorted(back.collect()) == sorted(rows.collect())


def test_csv_shape(rows, tmp_path):
    sinks.write_csv(rows.filter("article_hash = '2'"), str(tmp_path / "csv"), single_file=True)
    (part,) = (tmp_path / "csv").glob("part-*")
    header, line = part.read_text().splitlines()
    assert header.startswith("article_hash;article_title;category;publish_date")
    assert line == '2;"";;;;;;;;0.25;'


def test_json_round_trip(spark, rows, tmp_path):
    path = str(tmp_path / "json")
    sinks.write_json(rows, path)
    assert sorted(files.read_records_json(spark, path).collect()) == sorted(rows.collect())
    array = tmp_path / "array.json"
    array.write_text('[{"article_hash": "1", "view_count": 3}, {"article_hash": "2"}]')
    back = files.read_records_json(spark, str(array), S.ARTICLE, one_array=True).collect()
    assert [(r.article_hash, r.view_count) for r in back] == [("1", 3), ("2", None)]


def test_metrics_and_reset(spark, rows, tmp_path):
    sinks.write_metrics_csv(spark.range(3).withColumn("f", F.lit(0.5)), str(tmp_path / "m"))
    assert spark.read.csv(str(tmp_path / "m"), header=True).count() == 3
    path = str(tmp_path / "t")
    sinks.append_rows(rows, path)
    sinks.reset_table(spark, path, S.LISTING_EXPORT)
    assert spark.read.schema(S.LISTING_EXPORT).parquet(path).count() == 0


def test_sql_errors_are_raised(spark, rows):
    assert files.run_sql(spark, "SELECT count(*) AS n FROM {t}", t=rows).first().n == 3
    with pytest.raises(Exception):
        files.run_sql(spark, "SELECT missing FROM {t}", t=rows).collect()


def test_sql_leaves_the_views_of_the_session(spark, rows):
    spark.range(7).createOrReplaceTempView("own_view")
    try:
        both = files.run_sql(spark, "SELECT (SELECT count(*) FROM {own_view}) AS a, (SELECT count(*) FROM own_view) AS b", own_view=rows)
        assert both.first() == (3, 7)
        assert spark.table("own_view").count() == 7
    finally:
        spark.catalog.dropTempView("own_view")


def test_shared_dir_follows_the_session(spark):
    class Session:
        sparkContext = spark.sparkContext

        def __init__(self, value):
            self.conf = {"spark.checkpoint.dir": value}

    class Cluster(Session):
        class sparkContext:
            master = "spark://host:7077"

    assert shared_dir(Session("hdfs://shared/x")) == "hdfs://shared/x"
    local = shared_dir(Session(None))
    assert local == shared_dir(Session(None)) and "newsloom-" in local
    assert scratch_path(spark, "t") != scratch_path(spark, "t")
    assert shared_dir(Cluster("s3a://shared/x")) == "s3a://shared/x"
    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        shared_dir(Cluster(None))


def test_sorted_curve_with_a_hot_value(spark):
    values = [5] * 2000 + list(range(0, 3000, 7)) + [5]
    df = spark.createDataFrame([(v,) for v in values] + [(None,)], "v int")
    got = P.sorted_curve(df, F.col("v"), bucket=16, block=300).orderBy("rank").collect()
    assert [r.value for r in got] == sorted(values)
    assert [r.rank for r in got] == list(range(len(values)))


def test_profiles(spark):
    df = spark.createDataFrame(
        [("a" * n if n is not None else None,) for n in (0, 250, 499, 500, 5000, 5001, 7000, None)],
        "article_body string",
    )
    lengths = sorted(r.n for r in P.usual_length(df).select(F.length("article_body").alias("n")).collect())
    assert lengths == [500, 5000]
    assert tuple(P.outlier_counts(df).first()) == (3, 2, 8)
    bands = P.length_bands(df).select("low", F.length("article_body").alias("n")).collect()
    assert sorted(map(tuple, bands)) == [(0, 0), (0, 250), (5000, 5000), (5000, 5001), (7000, 7000)]
    assert P.drop_null_body(df).count() == 7
    assert tuple(P.frame_shape(df).first()) == (8, 1)
    row = P.describe(df, F.length("article_body")).first()
    assert (row["count"], row.p50, row.max) == (7, 500.0, 7000.0)
    assert {r.column_name: r.non_null for r in P.column_profile(df).collect()} == {"article_body": 7}
    assert tuple(P.length_profile(df, {"body": "article_body"}).first()) == (2607, 0, 7000)


def test_sample_is_exact_and_repeatable(spark):
    df = spark.range(500).withColumnRenamed("id", "k")
    one, two = (P.sample_rows(df, "k", 20, seed=s).collect() for s in (1, 2))
    assert len(one) == 20 and one == P.sample_rows(df.repartition(5), "k", 20, seed=1).collect() != two


def test_keys(spark):
    parent = spark.createDataFrame([("a",), ("b",), ("b",)], "k string")
    child = spark.createDataFrame([("a", 1), ("b", 2), ("c", 3), (None, 4)], "k string, n int")
    assert [tuple(r) for r in Q.key_violations(parent, "k").collect()] == [("b", 2)]
    assert sorted(r.n for r in Q.orphans(child, parent, "k").collect()) == [3, 4]
    assert sorted(r.n for r in Q.with_parent(child, parent, "k").collect()) == [1, 2]


def test_ranking_and_digest(spark):
    from conftest import plan_text

    now = datetime(2024, 1, 3)
    rows = [
        (1, "x", now, 0.1, 0.5), (2, "x", now, 0.9, 0.9), (3, "x", now, None, 0.9),
        (4, "x", now, 0.0, None), (5, "x", datetime(2023, 12, 1), 0.0, 1.0), (6, "y", now, 0.2, 0.3),
    ]
    df = spark.createDataFrame(
        rows, "id int, category string, publish_date timestamp_ntz, negative_score double, importance_score double"
    )
    ranked = R.top_by_importance(df, 2, "id")
    assert "WindowGroupLimit" in plan_text(ranked)
    assert sorted((r.category, r.rank, r.id) for r in ranked.collect()) == [
        ("x", 1, 5), ("x", 2, 2), ("y", 1, 6),
    ]
    readers = spark.createDataFrame([("r1", "x"), ("r2", "y"), ("r3", "z")], "reader string, category string")
    got = R.digest(df, readers, now, k=2, tie="id").collect()
    assert sorted((r.reader, r.rank, r.id) for r in got) == [("r1", 1, 1), ("r1", 2, 4), ("r2", 1, 6)]


def test_deviation_of_values_far_from_zero(spark):
    rows = spark.createDataFrame([(1e9 + i,) for i in (0.0, 1.0, 2.0, 3.0)], "v double")
    got = P.describe(rows, F.col("v")).first()
    assert got["count"] == 4 and got["std"] == pytest.approx(1.2909944487)


def test_insert_reads_the_buckets_of_the_batch(spark, tmp_path):
    path = str(tmp_path / "kept")
    rows = [(f"k{i % 300}", i) for i in range(600)]
    df = spark.createDataFrame(rows, "article_hash string, n int")
    assert sinks.stored_beside(df, path, "article_hash", 32) is None
    for batch in (df, df, spark.createDataFrame([("k1", 0), ("new", 1), ("new", 2), ("", 3), (None, 4)], df.schema)):
        sinks.insert_if_absent(batch, path, "article_hash", ["n"], buckets=32)
    got = spark.read.parquet(path).drop(sinks.BUCKET)
    assert sorted(map(tuple, got.collect())) == sorted([(f"k{i}", i) for i in range(300)] + [("new", 1)])
    stored = sinks.stored_beside(df.filter("article_hash = 'k7'"), path, "article_hash", 32)
    plan = stored._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(key_bucket" in plan and stored.select(sinks.BUCKET).distinct().count() == 1
    assert stored.filter("article_hash = 'k7'").count() == 1


def test_samples_of_any_size(spark):
    df = spark.createDataFrame([(i % 700 if i % 50 else None, i) for i in range(1400)], "k long, n int")
    digest = F.md5(F.concat(F.col("k").cast("string"), F.lit("-3")))
    order = [r.k for r in df.orderBy(digest, "k").collect()]
    for n, digits, few in ((0, 4, 10), (1, 1, 1), (27, 1, 3), (28, 2, 1), (29, 4, 10_000), (140, 1, 5), (1399, 2, 1), (1400, 4, 1), (5000, 4, 10)):
        got = [r.k for r in P.sample_rows(df, "k", n, 3, digits, few).collect()]
        assert sorted(map(str, got)) == sorted(map(str, order[:n])), (n, digits, few)
    assert P.sample_rows(df.limit(0), "k", 5).collect() == []
