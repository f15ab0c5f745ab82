"""Fingerprints, quality rules, toxicity and archives."""

import hashlib
import io
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from newsloom.llm import fingerprints, quality, toxicity, warc
from newsloom.llm.words import word_array, word_count


def slow_cuts(data):
    """One byte at a time."""
    out, start = [], 0
    while start < len(data):
        h, end = 0, min(start + fingerprints.MOST, len(data))
        for i in range(start, end):
            h = (h << 1) + int(fingerprints.GEAR[data[i]]) & 0xFFFFFFFF
            size = i - start + 1
            mask = int(fingerprints.STRICT if size < fingerprints.USUAL else fingerprints.LOOSE)
            if size >= fingerprints.LEAST and h & mask == 0:
                end = i + 1
                break
        out.append(end)
        start = end
    return out


def test_cuts():
    rng = np.random.default_rng(0)
    for n in (0, 1, 31, 32, 33, 192, 193, 5000):
        data = rng.integers(97, 123, n, dtype=np.uint8).tobytes()
        assert fingerprints.cuts(data) == slow_cuts(data)
    assert fingerprints.cuts(b"a" * 1000)[-1] == 1000
    data = rng.integers(97, 123, 9000, dtype=np.uint8).tobytes()
    a, b = (fingerprints.chunk_set(x, fingerprints.cuts(x)) for x in (data, b"inserted" + data))
    assert fingerprints.containment(a, b) > 0.9
    assert fingerprints.from_text(fingerprints.as_text(a)) == a


def slow_fingerprints(rows):
    rows = sorted(((k, t or "") for k, t in rows if k is not None))
    out = []
    for i, (k, t) in enumerate(rows):
        after = rows[(i + 1) % len(rows)][1]
        n = len(t) // 4
        other = t[: len(t) - n] + after[:n]
        a, b, c = (fingerprints.chunk_set(x.encode(), slow_cuts(x.encode())) for x in (t, other, after))
        digest = hashlib.sha256(other.encode()).hexdigest()
        near = (fingerprints.containment(a, b), fingerprints.containment(a, c))
        out.append((k, len(t), digest, fingerprints.as_text(a), fingerprints.as_text(b), *near))
    return out


def test_fingerprints_follow_the_order_of_ids(docs):
    rng = np.random.default_rng(1)
    rows = [(int(k), "é".join(f"w{x}" for x in rng.integers(0, 99, rng.integers(0, 150)))) for k in rng.permutation(300) * 7 - 500]
    rows += [(3000, None), (3001, ""), (3002, "short"), (3003, rows[0][1]), (3003, rows[1][1]), (3003, rows[1][1])]
    got = fingerprints.fingerprints(docs(rows).withColumnRenamed("lang", "fingerprint"))
    assert sorted(tuple(r) for r in got.collect()) == sorted(slow_fingerprints(rows))
    again = fingerprints.fingerprints(docs(rows[::-1]))
    assert sorted(map(tuple, again.collect())) == sorted(map(tuple, got.collect()))


def test_fingerprints_of_few_rows(docs):
    assert fingerprints.fingerprints(docs([])).collect() == []
    assert [tuple(r) for r in fingerprints.fingerprints(docs([(4, "one only")])).collect()] == slow_fingerprints([(4, "one only")])
    r = fingerprints.fingerprints(docs([(None, "four letters")])).collect()[0]
    assert r["edited_sha256"] == hashlib.sha256(b"four lett").hexdigest() and r["near_next"] == 0


QUALITY = ["", None, " \n ", "a b c d e a b c d e", "x " * 100, "one\none\n\n\n two \n two\nÉa#$ |", "a b c d e f " * 3 + "tail", "a\x0bb\x0cc\rd", "\n".join(["l"] * 9)]


def slow_statistics(text):
    text = text or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    seen = Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
    inside = {j for i in range(len(w) - 4) if seen[tuple(w[i : i + 5])] > 1 for j in range(i, i + 5)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(inside)


def test_statistics(docs):
    rng = np.random.default_rng(2)
    texts = QUALITY + ["\n".join(" ".join(f"{x}" for x in rng.integers(0, 4, 12)) for _ in range(20)) for _ in range(20)]
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    rows = docs(list(enumerate(texts))).select("doc_id", quality.statistics(F.col("text")).alias("s"), word_count(F.col("text")).alias("n"))
    for r in rows.collect():
        assert tuple(r["s"][n] for n in names) == slow_statistics(texts[r["doc_id"]])
        assert r["n"] == r["s"]["n_words"]


def labelled(spark, docs):
    rng = np.random.default_rng(3)
    rows, labels = [], []
    for i in range(600):
        words = [f"word{x}" for x in rng.integers(0, 5000, 60)]
        if i % 5 == 0:
            words = [w.upper() + "!!" for w in words]
        elif i % 5 == 1:
            words = [w if j % 2 else "|" for j, w in enumerate(words)]
        rows.append((i, " ".join(words)))
        labels.append((i, int(i % 5 > 1), int(i % 5 == 0)))
    return docs(rows), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_rules_are_learned(spark, docs):
    frame, labels = labelled(spark, docs)
    out = quality.judged(frame.withColumnRenamed("lang", "judgement"), labels)
    assert out.columns[-1] == "_judgement"
    rows = out.select("doc_id", "_judgement.*").collect()
    assert all(r["kept"] == (r["doc_id"] % 5 > 1) for r in rows)
    assert len({r["rule"] for r in rows}) >= 2 and not any(r["base_failed"] for r in rows)
    assert "Python" not in out._jdf.queryExecution().executedPlan().toString()


def test_rules_without_labels(spark, docs):
    none = spark.createDataFrame([], "doc_id long, quality int")
    one = spark.createDataFrame([(1, 1), (None, 0), (2, None)], "doc_id long, quality int")
    frame = docs([(1, "a " * 5), (2, " ".join(map(str, range(20)))), (None, None)])
    for labels in (none, one):
        out = quality.judged(frame, labels).select("doc_id", "judgement.kept", "judgement.rule").collect()
        assert sorted(tuple(r) for r in out if r[0]) == [(1, False, None), (2, True, None)]
    assert quality.judged(docs([]), none).collect() == []


def test_a_list_takes_its_first_rule(spark):
    rules = [(quality.Condition("a", True, 1.0),), (quality.Condition("a", True, 0.0), quality.Condition("b", False, 5.0))]
    values = {"a": F.col("a"), "b": F.col("b")}
    rows = spark.createDataFrame([(2.0, 1.0), (0.5, 5.0), (0.5, 6.0), (0.0, 0.0)], "a double, b double")
    got = [r[0] for r in rows.select(quality.decision_list(rules, values)).collect()]
    assert got == ["a > 1", "a > 0 and b <= 5", None, None]


def test_word_hashes_tell_words():
    h, n = toxicity.word_hashes(["The cat, the-CAT", "", "Éa éa 12", "!!"])
    assert n.tolist() == [4, 0, 3, 0]
    assert h[0] == h[2] and h[1] == h[3] and h[4] == h[5] and len(set(h.tolist())) == 4


def toxic_table(spark, docs, n=1500):
    rng = np.random.default_rng(4)
    rows, labels = [], []
    for i in range(n):
        words = [f"w{x}" for x in rng.integers(0, 800, rng.integers(5, 60))]
        if i % 6 == 0:
            words[rng.integers(0, len(words))] = ("scum", "idiot")[i % 2]
        rows.append((i, " ".join(words)))
        labels.append((i, int(i % 6 == 0)))
    return docs(rows), spark.createDataFrame(labels, "doc_id long, toxic int")


def test_toxicity_on_held_out_rows(spark, docs):
    frame, labels = toxic_table(spark, docs)
    extra = docs([(9001, None), (9002, ""), (None, "w1 scum w2"), (9004, "w5 " * 30000)])
    rows = toxicity.toxicity(frame.unionByName(extra).withColumn("score", F.lit("x")), labels).collect()
    held = [r for r in rows if r["held_out"] and r["doc_id"] < 9000]
    assert {r["doc_id"] for r in held} == {i for i in range(1500) if zlib.crc32(str(i).encode()) % 3 == 1}
    right = [r["predicted"] == (r["doc_id"] % 6 == 0) for r in held]
    assert sum(right) / len(right) > 0.97
    assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.7) for r in rows)
    by = {r["doc_id"]: r for r in rows}
    assert by[9001]["score"] == by[9002]["score"] == min(r["score"] for r in rows)
    assert by[9004]["predicted"] == 0 and by[None]["predicted"] == 1 and not by[None]["held_out"]


def test_toxicity_without_labels(spark, docs):
    none = spark.createDataFrame([], "doc_id long, toxic int")
    rows = toxicity.toxicity(docs([(1, "a b"), (2, None)]), none).collect()
    assert [r["predicted"] for r in rows] == [0, 0]
    assert toxicity.toxicity(docs([]), none).collect() == []


PAGES = [
    (5, "http://a/ b", "é" * 60), (2, "http://c", "é" * 60), (9, None, "é" * 60), (9, None, "é" * 60), (2, "u", "é" * 60),
    (1, "x", None), (3, "x", ""), (4, "\r\n\r\n", "\r\n\r\n"), (6, "z", "s" * 99), (7, "z", "s" * 99), (8, "z", "t" * 300000),
    (10, "z", "t" * 300000), (None, "n", "é" * 60), (None, "n", "r" * 100),
]


def test_archives_round_trip(spark):
    pages = spark.createDataFrame([(*p, "more") for p in PAGES], "page_id long, url string, html string, archive string")
    folder = warc.archive_folder(spark)
    archives = warc.write_archives(pages.repartition(3), folder)
    rows = warc.read_archives(spark, archives, folder).collect()
    key = lambda p: (str(p[0]), str(p[1]), str(p[2]))
    first = {"é" * 60: 2, "t" * 300000: 8}
    want, got = [], []
    for k, url, html in PAGES:
        data = (html or "").encode()
        revisit = html in first and first[html] != k
        want.append((k, url, len(data), hashlib.sha256(data).hexdigest(), "revisit" if revisit else "response", first[html] if revisit else None))
    for r in rows:
        got.append((r["page_id"], r["url"], r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]))
        if r["record_type"] == "response":
            assert hashlib.sha256(bytes(r["payload"])).hexdigest() == r["payload_digest"]
    assert sorted(got, key=key) == sorted(want, key=key)
    assert archives.agg(F.sum("n_records")).first()[0] == len(PAGES)


def test_empty_archives(spark):
    folder = warc.archive_folder(spark)
    archives = warc.write_archives(spark.createDataFrame([], "page_id long, url string, html string"), folder)
    assert warc.read_archives(spark, archives, folder).collect() == []


def test_damaged_archives_raise():
    good = warc.record_bytes(1, "u", b"p" * 500, None, "2024-01-01T00:00:00Z")
    other = warc.record_bytes(2, "u", b"", "<urn:page:1>", "2024-01-01T00:00:00Z")
    read = list(warc.records(io.BytesIO(good + other)))
    assert [(r["page_id"], r["record_type"], r["refers_to"]) for r in read] == [(1, "response", None), (2, "revisit", 1)]
    assert [r["offset"] for r in read] == [0, len(good)]
    with pytest.raises((ValueError, zlib.error)):
        list(warc.records(io.BytesIO(good[:-20])))
    plain = zlib.decompress(good, 31)
    for bad in (plain.replace(b"ppp", b"ppq", 1), plain[:-5] + plain[-4:]):
        packer = zlib.compressobj(6, zlib.DEFLATED, 31)
        with pytest.raises(ValueError):
            list(warc.records(io.BytesIO(packer.compress(bad) + packer.flush())))


def test_words(spark):
    text = "a\x0bb  c\r\nd\te\xa0f g"
    frame = spark.createDataFrame([(text,), (None,)], "t string")
    got = [r[0] for r in frame.select(word_array(F.col("t"))).collect()]
    assert got == [re.findall(r"[^\x20\x09-\x0D]+", text), []]
