"""Folders of pages as a source, SQL functions, and lists taken from the data."""

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from newsloom.functions import sql as SQL
from newsloom.functions import text as X
from newsloom.operators import incremental as I
from newsloom.plans.queries import QUERIES
from newsloom.sources import pages
from newsloom.streaming import dedupe

SMALL = "/root/testdata/sf0.001"


def test_pages_of_a_folder(spark, tmp_path):
    folder = str(tmp_path / "pages")
    rows = [(f"{i}.html", "ñ" * i * 1000 if i else None) for i in range(40)]
    pages.write_pages(spark.createDataFrame(rows, "name string, html string").repartition(3), folder)
    (tmp_path / "pages" / "_open").write_text("x")
    (tmp_path / "pages" / "bad.html").write_bytes(b"a\xffb")
    df = pages.read_pages(spark, folder)
    got = {r.name: r for r in df.collect()}
    assert len(got) == 41 and got["bad.html"].html == "a�b" and got["0.html"].html == ""
    assert all(got[n].html == h and got[n].size == 2 * len(h) for n, h in rows if h)
    few = spark.read.format(pages.FORMAT).option("path", folder).option("groupBytes", 100_000).load()
    assert few.rdd.getNumPartitions() > 5 and few.count() == 41
    assert pages.read_pages(spark, str(tmp_path / "none")).collect() == []


def test_failed_write_leaves_no_page(spark, tmp_path):
    folder = str(tmp_path / "pages")
    for name in (None, "a/b", "_x"):
        rows = spark.createDataFrame([("ok.html", "1"), (name, "2")], "name string, html string").coalesce(1)
        with pytest.raises(PySparkException):
            pages.write_pages(rows, folder)
    assert pages.read_pages(spark, folder).collect() == []


def test_pages_stream_in_deliveries(spark, tmp_path):
    folder, table, log = (str(tmp_path / x) for x in ("pages", "table", "log"))
    for part in (["a", "b"], ["c"], []):
        rows = [(f"{n}.html", n) for n in part]
        if rows:
            pages.write_pages(spark.createDataFrame(rows, "name string, html string"), folder)
        dedupe.append_stream(pages.stream_pages(spark, folder).select("name", "html"), table, log).awaitTermination()
    assert sorted(map(tuple, spark.read.parquet(table).collect())) == [("a.html", "a"), ("b.html", "b"), ("c.html", "c")]


def test_sql_chunks_equal_the_columns(spark):
    texts = ["", "one", "a. b. " * 300, "x" * 500 + ". y", " .  . ", "a" * 389 + ".b", None]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    SQL.register(spark)
    both = df.select("i", X.greedy_chunks(X.sentences(F.col("t"))).alias("want"), F.expr("article_chunks(t)").alias("got"))
    for r in both.collect():
        assert r.want == r.got, r.i
    rows = spark.sql("SELECT * FROM rouge_rows('the cat sat', 'the cat')").collect()
    assert [(r.metric, r.hits, r.precision) for r in rows] == [("rouge1", 2, 1.0), ("rougeL", 2, 1.0)]


def test_lists_of_all_values(spark):
    rows = [("b", 1), (None, 2), ("a", 3), ("xx", 4), ("b", 5)]
    got = I.numbered_lists(spark.createDataFrame(rows, "category string, n int"), "category")
    assert sorted((r.n, r.list_no) for r in got.collect()) == [(1, 1), (2, 3), (3, 0), (4, 2), (5, 1)]


def test_queries_read_all_of_their_tables(spark):
    assert QUERIES["search_hits"](spark, SMALL).filter("pos >= 3").count() > 0
    assert QUERIES["bullets"](spark, SMALL).filter("turn is null").count() > 0
