"""Mixing, token counts, and piece encoding."""

import pytest
import sentencepiece
from pyspark.sql import functions as F

from newsloom.llm import mixing, pieces, token_counts
from newsloom.llm.queries import tokenizer_path
from newsloom.session import scratch_path

MODEL = "piece_bpe_32k.model"


def targets(sizes, weights=(1, 2, 3), most=3.0):
    """Shares by weight, with those above their limit fixed and the rest shared anew, one source at a time."""
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    total, full = sum(sizes.values()), {}
    while True:
        rest = [s for s in names if s not in full]
        share = (total - sum(full.values())) / sum(weight[s] for s in rest)
        above = [s for s in rest if share * weight[s] > most * sizes[s]]
        if not above:
            return full | {s: share * weight[s] for s in rest}
        full |= {s: most * sizes[s] for s in above}


def mixed_rows():
    rows = []
    for s, n, words in (("b", 60, 9), ("a", 40, 50), (None, 30, 3), ("é", 2, 1), ("z", 50, 20), ("Z", 3, 0)):
        rows += [(len(rows) + i, " ".join(["w"] * (words + i % 3 * (words > 0))), s) for i in range(n)]
    return rows + [(None, None, "a"), (5, "twice", "b"), (5, "twice", "b")]


def test_targets_and_copies(docs):
    rows = mixed_rows()
    out = mixing.mix(docs(rows).withColumnRenamed("lang", "_size"), plan_only=True).collect()
    sizes = {}
    for _, t, s in rows:
        sizes[s] = sizes.get(s, 0) + len((t or "").split())
    want = targets(sizes)
    assert len(out) == len(rows)
    for r in out:
        assert r["source_size"] == sizes[r["source"]]
        assert r["target"] == pytest.approx(want[r["source"]])
        assert 0 <= r["copies"] <= 3
        rate = want[r["source"]] / sizes[r["source"]] if sizes[r["source"]] else 0
        assert r["copies"] in (int(rate + 1e-9), int(rate + 1e-9) + 1)
    assert sum(want.values()) == pytest.approx(sum(sizes.values()))


def test_mix_repeats_rows_and_keeps_columns(docs):
    frame = docs(mixed_rows()).withColumnRenamed("lang", "_found").withColumnRenamed("n_chars", "copies")
    plan = mixing.mix(frame, plan_only=True)
    count = {}
    for r in plan.collect():
        count[r["doc_id"]] = count.get(r["doc_id"], 0) + r["copies"]
    out = mixing.mix(frame)
    assert out.columns == frame.columns
    again = mixing.mix(frame).groupBy("doc_id").count().collect()
    assert {r["doc_id"]: r["count"] for r in again} == {k: n for k, n in count.items() if n}
    assert mixing.mix(docs([])).collect() == []


def test_ranks_follow_code_points(spark):
    names = [f"s{i:03}" for i in range(50)] + ["Z", "é", "ａ", "\U0001f600", "", None]
    frame = spark.createDataFrame([(n,) for n in names] * 3, "source string")
    got = {r["source"]: r["_rank"] for r in mixing.ranked(frame, "source").collect()}
    want = sorted((n for n in names if n is not None)) + [None]
    assert got == {n: i for i, n in enumerate(want)}


TEXTS = ["a b c", None, "", " two  spaces", "é 中 \U0001f600 ﬁ", "<s> </s>\n\ttab", "word " * 3000, "a b c", "x" * 5000, "\0 ▁"]


@pytest.mark.parametrize("name", [MODEL, "byte_bpe_50k.json"])
def test_token_counts(spark, docs, name):
    path, cache = tokenizer_path(name), scratch_path(spark, "cache")
    count = token_counts.encoder(path)
    frame = docs(list(enumerate(TEXTS))).withColumnRenamed("lang", "content_digest")
    out = token_counts.token_counts(frame, cache, path).collect()
    assert {r["doc_id"]: r["n_tokens"] for r in out} == dict(enumerate(count([t or "" for t in TEXTS])))
    assert {r["doc_id"]: r["n_bytes"] for r in out} == {i: len((t or "").encode()) for i, t in enumerate(TEXTS)}
    assert spark.read.parquet(cache).count() == len({t or "" for t in TEXTS})


def test_counts_are_those_of_the_libraries(spark, docs):
    import tokenizers

    pieces_model = sentencepiece.SentencePieceProcessor(model_file=tokenizer_path(MODEL))
    fast = tokenizers.Tokenizer.from_file(tokenizer_path("byte_bpe_50k.json"))
    slow = {MODEL: lambda t: len(pieces_model.encode(t)), "byte_bpe_50k.json": lambda t: len(fast.encode(t, add_special_tokens=False).ids)}
    for name, count in slow.items():
        out = token_counts.token_counts(docs(list(enumerate(TEXTS))), scratch_path(spark, "cache"), tokenizer_path(name)).collect()
        assert {r["doc_id"]: r["n_tokens"] for r in out} == {i: count(t or "") for i, t in enumerate(TEXTS)}


def test_only_needed_entries_leave_the_cache(spark, docs):
    path, cache = tokenizer_path(MODEL), scratch_path(spark, "cache")
    token_counts.token_counts(docs([(i, f"text {i}") for i in range(500)]), cache, path).collect()
    spark.read.parquet(cache).filter("n_tokens > 0").limit(100).write.mode("append").parquet(cache)  # stored twice
    few = docs([(1, "text 1"), (2, "text 2"), (3, "text 2"), (4, "unseen")])
    stored = token_counts.stored_counts(few, cache, token_counts.tokenizer_digest(path))
    assert stored.count() == 2
    assert token_counts.encode_misses(few, stored, cache, path).count() == 1
    assert token_counts.token_counts(few, cache, path).count() == 4


def test_cache_is_used_and_extended(spark, docs):
    path, cache = tokenizer_path(MODEL), scratch_path(spark, "cache")
    token_counts.token_counts(docs([(1, "a b"), (2, "c d")]), cache, path).collect()
    stored = spark.read.parquet(cache)
    assert stored.count() == 2
    changed = stored.withColumn("n_tokens", F.lit(99).cast("long")).collect()
    other = scratch_path(spark, "cache")
    spark.createDataFrame(changed, stored.schema).write.parquet(other)
    out = token_counts.token_counts(docs([(1, "a b"), (3, "new one"), (4, "new one")]), other, path).collect()
    assert {r["doc_id"]: r["n_tokens"] == 99 for r in out} == {1: True, 3: False, 4: False}
    assert spark.read.parquet(other).count() == 3
    assert token_counts.token_counts(docs([]), scratch_path(spark, "cache"), path).collect() == []


def test_other_tokenizer_versions_are_not_used(spark, docs):
    cache = scratch_path(spark, "cache")
    for name in (MODEL, "byte_bpe_50k.json"):
        token_counts.token_counts(docs([(1, "some text here")]), cache, tokenizer_path(name)).collect()
    stored = spark.read.parquet(cache)
    assert stored.count() == 2 and stored.select("tokenizer_digest").distinct().count() == 2


def test_pieces_equal_the_library(spark, docs):
    model = sentencepiece.SentencePieceProcessor(model_file=tokenizer_path(MODEL))
    texts = TEXTS + ["=" * 70 + " ==", "aaaa" * 40, "\n\n a\n", "  ", "tion" * 9 + "heon.\nÉa"]
    texts += ["".join(chr(97 + (i * i + j * j * 7) % 11) + " " * (i * j % 3) for i in range(60)) for j in range(40)]
    frame = docs(list(enumerate(texts))).withColumnRenamed("lang", "encoding")
    out = pieces.encoded(frame, tokenizer_path(MODEL))
    assert out.columns == ["doc_id", "encoding", "source", "n_chars", "_encoding"]
    for r in out.collect():
        text = texts[r["doc_id"]] or ""
        assert r["_encoding"]["ids"] == model.encode(text)
        assert r["_encoding"]["decoded"] == text.replace("▁", " ")
    assert pieces.encoded(docs([]), tokenizer_path(MODEL)).collect() == []


def test_occurrences_are_all_found():
    import numpy as np

    tables = pieces.load(tokenizer_path(MODEL))
    text = "▁the▁nation▁internationalization\0▁in▁中"
    data = np.frombuffer(text.encode() + b"\0", np.uint8)
    starts = np.flatnonzero((data & 0xC0) != 0x80)
    order, keys = pieces.suffix_array(data, starts, 48)
    low, high = pieces.occurrences(tables, keys)
    raw = text.encode()
    for i, a, b in zip(tables.ids.tolist(), low, high, strict=True):
        t = tables.texts[i]
        assert sorted(order[a:b].tolist()) == [p for p in range(len(raw)) if raw.startswith(t, p)], t
