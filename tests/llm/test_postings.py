"""The positional index against plain scans."""

import hashlib
import re
from itertools import product

import numpy as np
import pytest

from newsloom.llm import lexing, postings


def words_of(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)


def slow(docs, items, window=10, reach=2.0):
    out = []
    for key, text in docs:
        w = words_of(text)
        hit, found, close = set(), set(), set()
        for item, words in ((i, words_of(t)) for i, t in items):
            n = min(window, len(words))
            grams = {tuple(words[i : i + n]) for i in range(len(words) - n + 1)} if n else set()
            at = [i for i in range(len(w) - n + 1) if tuple(w[i : i + n]) in grams] if grams else []
            for i in at:
                hit.update(range(i, i + n))
            if at and item is not None:
                found.add(str(item))
            span = int(np.ceil(reach * len(words)))
            if words and item is not None and any(set(words) <= set(w[i : i + span]) for i in range(len(w))):
                close.add(str(item))
        out.append((str(key), len(w), len(hit), sorted(found), sorted(close)))
    return sorted(out)


def cases():
    rng = np.random.default_rng(3)
    vocabulary = ["the", "of", "Straße", "x1", "WORD", "été", "日本", "b", "c", "d"]
    text = lambda n: " ".join(rng.choice(vocabulary, n))
    items = [(i, text(int(rng.integers(4, 25)))) for i in range(30)]
    items += [(3, "again and again"), (40, "one"), (41, None), (42, ""), (43, " .,!"), (None, "lonely item words"), (44, items[0][1]), (45, "THE-of_the")]
    docs = [(i, text(int(rng.integers(0, 200)))) for i in range(60)]
    for i, (_, t) in enumerate(items):
        docs.append((100 + i, f"{text(5)} {(t or '').upper()}! {text(4)}"))
        docs.append((200 + i, " ".join(rng.permutation((t or "a").split() or ["a"]))))
    docs += [(300, None), (301, ""), (None, items[1][1]), (None, "x"), (0, items[2][1]), (0, items[2][1]), (302, "the " * 3000)]
    # A phrase that two neighbouring documents have half of each is in neither.
    docs += [(400, "lonely item"), (401, "words lonely")]
    return docs, items


def got(rows):
    rows = [(str(r[0]), r.hits.n_words, r.hits.n_hit, r.hits["items"], r.hits.near_items) for r in rows.collect()]
    return sorted(rows)


@pytest.mark.parametrize("block,queries", [(12 << 20, 100_000), (300, 7)])
def test_hits_against_scan(spark, monkeypatch, block, queries):
    docs, items = cases()
    monkeypatch.setattr(postings, "BLOCK", block)
    monkeypatch.setattr(postings, "QUERIES", queries)
    d = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    i = spark.createDataFrame([(k, t, 1) for k, t in items], "item_id long, text string, doc_id int")
    assert got(postings.benchmark_hits(d, i)) == slow(docs, items)


def test_spans_and_decontaminated(spark):
    docs = [(1, "a b c d e f", "s"), (2, "x", "s"), (None, "a b c", "s")]
    d = spark.createDataFrame(docs, "doc_id long, text string, hits string")
    i = spark.createDataFrame([(9, "b c"), (10, "C d E")], "item_id long, text string")
    row = next(r for r in postings.benchmark_hits(d, i).collect() if r[0] == 1)
    assert [(s.start, s.end) for s in row.hits.spans] == [(1, 5)] and row.hits["items"] == ["10", "9"]
    kept = postings.decontaminated(d, i)
    assert kept.columns == ["doc_id", "text", "hits"] and sorted(str(r.doc_id) for r in kept.collect()) == ["2", "None"]


def test_empty_tables(spark):
    d = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    i = spark.createDataFrame([(1, "a b")], "item_id long, text string")
    assert postings.benchmark_hits(d.limit(0), i).collect() == []
    row = postings.benchmark_hits(d, i.limit(0)).first()
    assert (row.hits.n_words, row.hits.n_hit, row.hits["items"]) == (2, 0, [])


def test_index_is_whole(spark):
    docs, _ = cases()
    rows = postings.build_index(spark.createDataFrame(docs, "doc_id long, text string")).collect()
    lists = {(r.block, r.term): postings.places_of(r["first"], r.n, r.gaps) for r in rows if r.term}
    total = sum(len(words_of(t)) for _, t in docs)
    assert sum(map(len, lists.values())) == total == sum(r.n for r in rows if r.term is None)
    for block in {r.block for r in rows}:
        mine = sorted(p for (b, _), v in lists.items() if b == block for p in v.tolist())
        assert mine == list(range(len(mine)))


def test_near_is_least(spark):
    rng = np.random.default_rng(4)
    for _ in range(200):
        lengths = rng.integers(0, 30, 4)
        text = rng.integers(0, 6, lengths.sum())
        block = postings.Block(lengths, 6)
        for t in range(6):
            at = np.flatnonzero(text == t)
            if len(at):
                gaps = np.diff(at).astype("<u4").tobytes()
                block.add(t, int(at[0]), len(at), gaps)
        terms = np.unique(rng.integers(0, 6, 3))
        reach = int(rng.integers(1, 12))
        if not (block.counts[terms] > 0).all():
            continue
        whole = [(a, b) for s, e in zip(block.starts, block.ends, strict=True) for a, b in product(range(s, e), range(s, e + 1))
                 if a < b <= a + reach and set(terms.tolist()) <= set(text[a:b].tolist())]
        least = sorted((a, b) for a, b in whole if not any((x, y) != (a, b) and a <= x and y <= b for x, y in whole))
        starts, ends = block.near(terms, reach)
        assert list(zip(starts.tolist(), ends.tolist(), strict=True)) == least


def test_words_and_order():
    texts = ["A b\tC", "", "d;e  F", "\0x"]
    words = lexing.Words([t.encode() for t in texts], lexing.byte_classes(b" \t", b";"))
    assert [words.data[a:b] for a, b in zip(words.start, words.end, strict=True)] == [b"a", b"b", b"c", b"d", b"e", b"f", b"\0x"]
    assert words.joined.tolist() == [True, True, False, False, True, False, False] and words.text.tolist() == [0, 0, 0, 2, 2, 2, 3]
    codes = np.random.default_rng(5).integers(0, 1 << 20, 5000)
    assert (lexing.stable_order(codes) == np.argsort(codes, kind="stable")).all()


def test_digest_of_no_items():
    assert hashlib.sha256(b"").hexdigest().startswith("e3b0c442")
