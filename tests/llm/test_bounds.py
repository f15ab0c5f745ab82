"""Bounds on what reaches the driver, and archives of other writers."""

import gzip
import hashlib
import io
from base64 import b32encode

import pytest

from newsloom.llm import quality, toxicity, warc


def test_one_row_for_each_labelled_id(spark):
    """A labelled id on very many rows, and with several labels, is one row of the samples."""
    docs = spark.range(100_000).selectExpr("7L AS doc_id", "concat('same words ', id % 50) AS text", "'en' AS lang")
    docs = docs.unionByName(spark.createDataFrame([(8, "other text", "de"), (10, None, None), (None, "x", "en")], "doc_id long, text string, lang string"))
    labels = spark.createDataFrame([(7, 1, 1), (7, 0, 0), (8, 0, 1), (10, 1, 0), (None, 1, 1), (11, 1, 1)] + [(7, 1, 1)] * 50, "doc_id long, toxic int, quality int")
    rows = toxicity.training_rows(docs, labels, "toxic", 1000, 10**6, 6).collect()
    assert sorted((r.doc_id, r.label) for r in rows) == sorted({(7, 1), (8, 0), (10, 1)} - {(k, v) for k, v in ((7, 1), (8, 0), (10, 1)) if not held(k)})
    few = toxicity.training_rows(docs, labels, "toxic", 1000, 1, 6).collect()
    assert len(few) <= 1  # the share comes from the characters of the labelled texts
    assert sorted(r["_bad"] for r in quality.labelled_features(docs, labels, "quality", "text", 1000, 10).collect()) == [0, 1, 1]


def held(key):
    import zlib

    return zlib.crc32(str(key).encode()) % 3 != 1


def member(fields, block, version="WARC/1.0"):
    lines = "".join(f"{k}: {v}\r\n" for k, v in fields)
    return gzip.compress(f"{version}\r\n{lines}Content-Length: {len(block)}\r\n\r\n".encode() + block + b"\r\n\r\n")


def test_archive_of_another_writer():
    body = b"<p>hello</p>"
    http = b"HTTP/1.0 200 OK\r\nServer: x\r\n\r\n" + body
    sha1 = lambda data: "sha1:" + b32encode(hashlib.sha1(data).digest()).decode()
    response = [("WARC-Type", "response"), ("WARC-Record-ID", "<urn:uuid:1-2-3>"), ("WARC-Target-URI", "http://a/b?c=%20d")]
    archive = member([("WARC-Type", "warcinfo"), ("WARC-Record-ID", "<urn:uuid:0>")], b"software: y")
    archive += member([*response, ("WARC-Payload-Digest", sha1(body)), ("WARC-Block-Digest", sha1(http))], http)
    archive += member([("WARC-Type", "request"), ("WARC-Record-ID", "<urn:uuid:5>")], b"GET / HTTP/1.0\r\n\r\n", "WARC/1.1")
    archive += member(response, http)
    got = list(warc.records(io.BytesIO(archive)))
    assert [(r["url"], r["page_id"], r["payload"], r["payload_bytes"]) for r in got] == [("http://a/b?c=%20d", None, body, len(body))] * 2
    assert {r["payload_digest"] for r in got} == {hashlib.sha256(body).hexdigest()}
    for name in ("WARC-Payload-Digest", "WARC-Block-Digest"):
        with pytest.raises(ValueError):
            list(warc.records(io.BytesIO(member([*response, (name, sha1(b"other"))], http))))
    with pytest.raises(ValueError):
        list(warc.records(io.BytesIO(member(response, http, "WARC/2.0"))))


@pytest.mark.parametrize("url", ["http://a/b", "http://a/ü b?\r\nX: y", "100% <x>", "", None, "urn:page:3", "http://a/%zz"])
def test_target_addresses(url):
    record = warc.record_bytes(3, url, b"x", None, "2024-01-01T00:00:00Z")
    head = gzip.decompress(record).split(b"\r\n\r\n")[0].decode("ascii")
    target = next(x for x in head.split("\r\n") if x.startswith("WARC-Target-URI: "))
    assert " " not in target.removeprefix("WARC-Target-URI: ") and [r["url"] for r in warc.records(io.BytesIO(record))] == [url]


def test_toxicity_learns_from_all_labelled_rows(spark):
    """More labelled rows than one task takes: a word that few of them have is learned, and all tasks' rows count."""
    rows = [(i, " ".join(f"w{(i * 7 + k * k) % 500}" for k in range(20)) + (" scum" if i % 6 == 0 else " vile" if i % 50 == 1 else ""), "de" if i % 2 else "en") for i in range(3000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(4)
    labels = spark.createDataFrame([(i, int(i % 6 == 0 or i % 50 == 1)) for i in range(3000)], "doc_id long, toxic int").repartition(4)
    assert toxicity.training_rows(docs, labels, "toxic").count() == sum(held(i) for i in range(3000))
    found = toxicity.toxicity(docs, labels, task_rows=600).collect()
    tested = [r for r in found if r["held_out"]]
    right = [r["predicted"] == int(r["doc_id"] % 6 == 0 or r["doc_id"] % 50 == 1) for r in tested]
    assert len(found) == 3000 and sum(right) / len(right) > 0.97
    again = toxicity.toxicity(docs, labels, task_rows=600)
    assert sorted((r["doc_id"], round(r["score"], 4)) for r in again.collect()) == sorted((r["doc_id"], round(r["score"], 4)) for r in found)


def test_toxicity_of_one_label_over_several_tasks(spark):
    docs = spark.createDataFrame([(i, f"a {i}" if i % 3 else None, None) for i in range(60)], "doc_id long, text string, lang string")
    for label in (0, 1):
        labels = docs.selectExpr("doc_id", f"{label} AS toxic")
        assert {r["predicted"] for r in toxicity.toxicity(docs, labels, task_rows=5).collect()} == {label}
