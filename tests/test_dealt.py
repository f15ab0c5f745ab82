"""Costly work on rows is spread over tasks, and done once."""

import pytest
from pyspark.sql import functions as F

from newsloom.functions import sql
from newsloom.plans import queries as Q
from newsloom.plans import rounds as L
from tests.conftest import plan_text


@pytest.fixture
def tables(spark, tmp_path):
    """One file with one row group for each table."""
    docs = [(i, f"Title {i}\nFirst part of {i}. Second part of it. Third.", "en", "s") for i in range(40)] + [(40, None, None, None), (41, "", "en", "s")]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    turns = [(c, t, ("user", "assistant")[t % 2], f"words of {c} and {t}") for c in range(5) for t in range(4)] + [(9, 0, "user", None), (9, 1, "assistant", "x")]
    spark.createDataFrame(turns, "conv_id long, turn long, role string, text string").coalesce(1).write.parquet(f"{tmp_path}/conversations.parquet")
    return str(tmp_path)


def test_rounds_of_one_file_are_spread(spark, tables):
    docs = spark.read.parquet(f"{tables}/documents.parquet")
    assert docs.rdd.getNumPartitions() == 1
    rounds = L.rechunk_rounds(docs, ["doc_id"], body="text")
    sizes = rounds.groupBy(F.spark_partition_id()).count().collect()
    assert len(sizes) == 8 and sum(r["count"] for r in sizes) == 42


@pytest.mark.parametrize("name", ["summary_constraints", "rouge_frame"])
def test_rounds_are_not_computed_again_for_a_filter_or_a_sort(spark, tables, name):
    rows = Q.QUERIES[name](spark, tables)
    assert "ArrowEvalPython" not in plan_text(rows) and "documents.parquet" not in plan_text(rows)
    assert rows.count() == 40  # neither the null text nor the empty one has rounds


def test_sql_functions_stay_in_their_rows(spark, tables):
    rows = Q.QUERIES["sql_functions"](spark, tables)
    chunks, scores = plan_text(rows).split("BatchEvalPythonUDTF")
    assert chunks.count("Join") == 0  # chunks are not joined back by their text
    assert "Filter" in scores.split("Join")[1] and rows.filter("metric is not null").count() == 2 * 11


def test_chunk_rows_are_those_of_the_array(spark):
    docs = spark.createDataFrame([(1, "a. b" * 200), (2, None), (3, ""), (4, "..."), (5, "x" * 400 + ". y"), (1, "a. b" * 200)], "i int, body string")
    sql.register(spark)
    got = spark.sql("SELECT i, pos, chunk FROM {docs}, LATERAL chunk_rows(body)", docs=docs)
    want = docs.selectExpr("i", "article_chunks(body) AS c").selectExpr("i", "posexplode(c) AS (pos, chunk)")
    assert sorted(got.collect()) == sorted(want.collect()) and "Join" not in plan_text(got)
