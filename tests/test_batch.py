from datetime import datetime, timedelta

from pyspark.sql import functions as F

from newsloom.plans import batch as B
from newsloom.schema import ARTICLE

NOW = datetime(2024, 5, 2, 12)
LIST = "hash_id string, title string, link string, publish_date timestamp_ntz, category string, entity string, pos int"


def row(key, pos, title="t", at=None):
    return (key, title, f"/{key}", at, "c", "e", pos)


def test_load_by_key(spark):
    one = spark.createDataFrame([row("a", 0), row("b", 1), row("b", 2, "late")], LIST)
    two = spark.createDataFrame([row("b", 0, "second list"), row("c", 1, at=NOW), row("d", 2)], LIST)
    stored = spark.createDataFrame([("a",), ("x",)], "article_hash string")
    bodies = spark.createDataFrame(
        [(k, f"Uno {k}. Dos", NOW - timedelta(hours=1), i) for i, k in enumerate("abc")]
        + [("b", "copy", NOW, 9)],
        "hash_id string, article_body string, page_date timestamp_ntz, note_id long",
    )
    views = spark.createDataFrame([(1, 5), (1, 4), (2, None)], "note_id long, view_count long")
    rows = B.load_by_key([one, two], stored, bodies, views, method="lead")
    assert [f.name for f in rows.schema] == ARTICLE.names
    assert [f.dataType for f in rows.schema] == [f.dataType for f in ARTICLE]
    found = rows.collect()
    got = {r.article_hash: r for r in found}
    assert len(found) == 2 and set(got) == {"b", "c"}  # `d` has no body
    assert (got["b"].article_title, got["b"].view_count) == ("t", 5)
    assert got["b"].publish_date == NOW - timedelta(hours=1) and got["c"].publish_date == NOW
    assert got["b"].generated_summary == "Uno b"


def test_load_by_date(spark):
    listing = spark.createDataFrame(
        [("n1", "e", "c", NOW, 0), ("n2", "e", "c", NOW - timedelta(hours=2), 1),
         ("old", "e", "c", NOW - timedelta(hours=5), 2), ("hidden", "e", "c", NOW, 3), ("n1", "e", "c", NOW, 0)],
        "article_hash string, source_entity string, category string, publish_date timestamp_ntz, pos int",
    )
    stored = spark.createDataFrame(
        [("e", "c", NOW - timedelta(hours=5))],
        "source_entity string, category string, publish_date timestamp_ntz",
    )
    bodies = spark.createDataFrame([("n1", "body"), ("n1", "copy")], "article_hash string, article_body string")
    got = B.load_by_date(listing, stored, bodies, NOW).collect()
    assert sorted((r.article_hash, r.article_body or "-") for r in got) == [("n1", "body"), ("n2", "-")]
    assert B.load_by_date(listing, stored, bodies.filter(F.lit(False)), NOW).isEmpty()
