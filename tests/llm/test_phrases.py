"""Collocations against plain counting."""

import re
from collections import Counter

import numpy as np
import pytest

from newsloom.llm import phrases


def pieces_of(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return [re.findall(r"[^\x20\x09]+", p) for p in re.split(r"[.,;:!?\x0A-\x0D]", low)]


def slow_counts(docs, longest, least):
    counts = Counter()
    for lang, text in docs:
        for words in pieces_of(text):
            for n in range(1, longest + 1):
                for i in range(len(words) - n + 1):
                    counts[lang or "und", tuple(words[i : i + n])] += 1
    total = Counter()
    for (lang, words), n in counts.items():
        total[lang] += n if len(words) == 1 else 0
    return {k: n for k, n in counts.items() if n >= least}, total


def slow(docs, longest=3, least=10, percent=50, top=2000):
    counts, total = slow_counts(docs, longest, least)
    rows = {}
    for (lang, words), a in counts.items():
        if len(words) < 2:
            continue
        inside = [b for (x, w), b in counts.items() if x == lang and len(w) > len(words) and any(w[i : i + len(words)] == words for i in range(len(w)))]
        if any(100 * b >= percent * a for b in inside):
            continue
        cuts = []
        for k in range(1, len(words)):
            l, r = counts[lang, words[:k]], counts[lang, words[k:]]  # noqa: E741
            cuts.append((10**6 * a * a // (l * r), k, l, r))
        score, _, l, r = min(cuts)  # noqa: E741
        rows.setdefault(lang, []).append((-score, -a, " ".join(words).encode(), l, r))
    out = []
    for lang, mine in rows.items():
        for rank, (score, a, phrase, l, r) in enumerate(sorted(mine)[:top], 1):  # noqa: E741
            out.append((lang, rank, phrase.decode(), -a, l, r, total[lang], -score))
    return sorted(out)


def cases():
    rng = np.random.default_rng(6)
    vocabulary = [f"w{i}" for i in range(12)] + ["Über", "日本", "Z", "été", "x-y", "\0", " ", " q"]
    marks = [" ", "  ", " \t ", ", ", ".", "\n", "\r\n", " ;", "?! "]

    def text(n):
        words = rng.choice(vocabulary, n)
        between = rng.choice(marks, n, p=[0.6, 0.1, 0.05, 0.05, 0.05, 0.05, 0.04, 0.03, 0.03])
        return "".join(w + b for w, b in zip(words, between, strict=True))

    docs = [(str(rng.choice(["en", "de"])), text(int(rng.integers(0, 120)))) for _ in range(60)]
    passage = text(80)
    docs += [("en", f"{text(3)} {passage} {text(4)}") for _ in range(25)]
    docs += [("und", text(60)), (None, text(90)), (None, None), ("en", ""), ("en", " .,\n"), ("fr", "a " * 400), ("en", "New York City " * 12), ("xx", "once")]
    return docs


def frame(spark, docs):
    rows = [(t, x, i, i) for i, (x, t) in enumerate(docs)]
    return spark.createDataFrame(rows, "text string, lang string, phrase int, n long")


@pytest.mark.parametrize("block,texts,longest", [(8 << 20, 4 << 20, 3), (400, 300, 3), (900, 4 << 20, 4), (8 << 20, 4 << 20, 2)])
def test_collocations_against_counting(spark, monkeypatch, block, texts, longest):
    monkeypatch.setattr(phrases, "BLOCK", block)
    monkeypatch.setattr(phrases, "TEXTS", texts)
    docs = cases()
    df = frame(spark, docs).repartition(3)
    got = sorted(tuple(r) for r in phrases.collocations(df, longest=longest, least=4, top=150).collect())
    assert got == slow(docs, longest=longest, least=4, top=150) and len(got) > 100


def test_counts_and_dictionary(spark):
    docs = cases()
    rows = phrases.phrase_counts(frame(spark, docs), least=2).collect()
    counts, total = slow_counts(docs, 3, 2)
    assert {(r.lang, tuple(r.phrase.split(" "))): r.n for r in rows if r.words} == counts
    assert {r.lang: r.n for r in rows if not r.words} == total
    chunks = phrases.chunks(frame(spark, docs), "text", "lang", 3).collect()
    assert len(chunks) == len({(r.lang, bytes(r.chunk), r.overlap) for r in chunks}) and max(r.n for r in chunks) >= 20
    starts = sum(r.n * (sum(map(len, pieces_of(bytes(r.chunk).decode()))) - r.overlap) for r in chunks)
    assert starts == sum(total.values())


def test_large_counts_and_empty(spark):
    from pyspark.sql import functions as F

    row = spark.createDataFrame([(3 * 10**14 + 7, 9 * 10**14 + 1, 8 * 10**14 + 3)], "a long, l long, r long").select(phrases.exact_score("a", "l", "r").alias("s"), F.lit(1)).first()
    assert row.s == 10**6 * (3 * 10**14 + 7) ** 2 // ((9 * 10**14 + 1) * (8 * 10**14 + 3))
    assert phrases.collocations(frame(spark, []).limit(0)).collect() == []
    assert phrases.collocations(frame(spark, [("en", None), (None, "")])).collect() == []
