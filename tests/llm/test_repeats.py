"""Removal of repeated passages, in words and in bytes, against brute force."""

import hashlib

import numpy as np
import pytest

from newsloom.llm import sorted_runs, substrings, suffixes
from newsloom.llm.runs import Hashes, anchored, sliding_least


def words_of(text):
    return (text or "").encode().split()


def slow(rows, items, window):
    """Masks of what goes, by a set of all windows of each document."""
    first = {}
    for k, t in rows:
        x = items(t)
        for p in range(len(x) - window + 1):
            key = tuple(x[p : p + window])
            if k is not None:
                first[key] = min(first.get(key, k), k)
    masks = []
    for k, t in rows:
        x = items(t)
        mask = np.zeros(len(x), bool)
        for p in range(len(x) - window + 1):
            if k is not None and first[tuple(x[p : p + window])] < k:
                mask[p : p + window] = True
        masks.append(mask)
    return masks


def corpus(seed=3, vocabulary=40):
    """Texts that share passages of many lengths, wholly and partly, some within themselves."""
    rng = np.random.default_rng(seed)
    word = lambda n: " ".join(f"w{x}" for x in rng.integers(0, vocabulary, n))
    shared = [word(n) for n in (49, 50, 51, 60, 75, 130, 400)]
    rows = []
    for i in range(40):
        a, b, c = rng.integers(0, len(shared), 3)
        cut = shared[c].split()
        at = rng.integers(0, len(cut))
        rows.append(" ".join([word(rng.integers(0, 30)), shared[a], word(2), shared[b], word(1), *cut[at:], word(3), *cut[:at]]))
    rows += [rows[0], rows[0], "", None, " \n", "é" * 300, "é" * 299, "x " * 400, "x " * 380, "a" * 49, "a" * 50, "a" * 51]
    rows += [f"{shared[6]}\n{shared[6]}", shared[6].replace(" ", "\t")]
    order = rng.permutation(len(rows))
    return [(int(k), t) for k, t in zip(order, rows, strict=True)]


def removed_words(frame):
    return {r["doc_id"]: (r["removal"]["n_words"], r["removal"]["n_removed"], r["text"]) for r in frame.collect()}


@pytest.mark.parametrize("window", [50, 7])
def test_words(docs, window):
    rows = corpus()
    got = removed_words(substrings.remove_repeats(docs(rows), window=window))
    for (k, t), mask in zip(rows, slow(rows, words_of, window), strict=True):
        kept = b" ".join(w for w, m in zip(words_of(t), mask, strict=True) if not m).decode()
        assert got[k] == (len(mask), mask.sum(), None if t is None else kept)


def test_words_with_null_keys_and_taken_names(docs):
    rows = [(None, "q " * 60), (1, "q " * 60), (None, "q " * 60)]
    frame = docs(rows).withColumnRenamed("lang", "removal").withColumnRenamed("source", "_doc")
    out = substrings.remove_repeats(frame)
    assert out.columns == [*frame.columns, "_removal"]
    assert [r["_removal"]["n_removed"] for r in out.collect()] == [0, 0, 0]
    assert substrings.remove_repeats(docs([])).collect() == []
    with pytest.raises(ValueError):
        substrings.remove_repeats(frame, window=3)


def test_single_windows_of_repeated_rows(spark, docs):
    """n equal rows give each window once, not once for each pair of them."""
    text = " ".join(f"w{i}" for i in range(12))
    rows = docs([(1, text)] * 5 + [(2, text)])
    content = rows.select(substrings._content(rows["text"])).first()[0]
    groups = spark.createDataFrame([(1, content, 9, 2, 3)] * 5 + [(1, content, 9, 7, 1)] * 5, "doc long, content long, one long, first long, n long")
    got = substrings.single_windows(rows, groups, "doc_id", "text", 4).collect()
    assert sorted((r["doc"], r["place"]) for r in got) == [(1, 2), (1, 3), (1, 4), (1, 7)]


@pytest.mark.parametrize("packed", [suffixes.PACKED, 50])
def test_bytes(docs, monkeypatch, packed):
    monkeypatch.setattr(suffixes, "PACKED", packed)
    if packed == 50:
        monkeypatch.setattr(suffixes, "SORTED", 40)
        monkeypatch.setattr(suffixes, "HELD", 2)
    rows = corpus(seed=4, vocabulary=60)
    out = suffixes.remove_repeats(docs(rows)).collect()
    got = {r["doc_id"]: r["removal"] for r in out}
    for (k, t), mask in zip(rows, slow(rows, lambda t: (t or "").encode(), 50), strict=True):
        data = np.frombuffer((t or "").encode(), np.uint8)
        kept, r = data[~mask].tobytes(), got[k]
        spans = np.flatnonzero(np.diff(mask, prepend=False, append=False)).reshape(-1, 2).tolist()
        assert (r["n_bytes"], r["n_removed"], r["n_spans"]) == (len(data), mask.sum(), len(spans)), k
        assert [[s["start"], s["end"]] for s in r["spans"]] == spans
        assert bytes(r["kept"]) == kept and r["kept_sha256"] == hashlib.sha256(kept).hexdigest()


def test_bytes_with_null_and_repeated_keys(docs):
    same = "the quick brown fox jumps over the lazy dog again and again until dawn"
    rows = [(None, same), (4, same), (4, same), (9, f"{same}!"), (None, same)]
    out = suffixes.remove_repeats(docs(rows).withColumnRenamed("lang", "removal"))
    assert sorted((r["doc_id"] or 0, r["_removal"]["n_removed"]) for r in out.collect()) == [
        (0, 0), (0, 0), (4, 0), (4, 0), (9, len(same)),
    ]
    assert suffixes.remove_repeats(docs([])).collect() == []


def test_merge_of_runs():
    rng = np.random.default_rng(5)
    keys = [bytes(rng.integers(97, 99, rng.integers(0, 9), dtype=np.uint8)) for _ in range(400)]
    runs = [sorted(set(keys[i::7])) for i in range(7)] + [[]]
    assert [[k for k, _ in sorted_runs.decoded(sorted_runs.front_coded(r))] for r in runs] == runs
    tree = sorted_runs.LoserTree([sorted_runs.decoded(sorted_runs.front_coded(r)) for r in runs])
    merged = list(tree)
    assert [k for _, k, _ in merged] == sorted(k for r in runs for k in r)
    for (_, one, _), (_, two, shared) in zip(merged, merged[1:], strict=False):
        assert one[:shared] == two[:shared] and (one == two) == (shared == len(one) == len(two))
    assert sorted_runs.unpack(sorted_runs.pack(np.array([-5, 0, 2**40]))).tolist() == [-5, 0, 2**40]


def test_every_window_has_its_anchor():
    rng = np.random.default_rng(6)
    lengths = np.array([0, 3, 50, 200, 49, 51])
    items = rng.integers(0, 3, lengths.sum(), dtype=np.uint64)
    first, n, anchor, which = anchored(Hashes(items), lengths, 50, 16)
    assert n.sum() == np.maximum(lengths - 49, 0).sum()
    starts = np.cumsum(lengths) - lengths
    assert (first >= starts[which]).all() and (first + n + 49 <= starts[which] + lengths[which]).all()
    assert (anchor >= first + n - 1).all() and (anchor + 16 <= first + 50).all()
    values = rng.integers(0, 100, 60)
    assert sliding_least(values, 11).tolist() == [values[i : i + 11].min() for i in range(50)]


def test_long_text_of_one_character(spark, docs, monkeypatch):
    """Places of one key lie close together: they stay one entry, however many they are."""
    monkeypatch.setattr(suffixes, "SORTED", 700)
    one, two = "a" * 40_000, "ab" * 20_000
    rows = [(1, one + "x"), (2, "y" + one), (3, two), (4, two[1:] + "z"), (5, "q" * 49), (6, "q" * 49), (7, "b" + "a" * 49 + "c"), (8, one + "x"), (None, one)]
    got = {r.doc_id: r.removal for r in suffixes.remove_repeats(docs(rows)).collect()}
    assert bytes(got[1].kept).decode() == rows[0][1] and bytes(got[2].kept) == b"y" and bytes(got[3].kept).decode() == two
    assert bytes(got[4].kept) == b"z" and got[5].n_removed == got[6].n_removed == got[7].n_removed == 0
    assert got[8].n_removed == 40_001 and got[8].n_spans == 1 and got[None].n_removed == 0


def test_passages_across_blocks_of_words(spark):
    """More words in one task than it hashes together: a passage is found in whichever blocks its documents fall."""
    from newsloom.llm import substrings

    passage = [f"p{k}" for k in range(60)]
    own = lambda i: [f"d{i}w{k}" for k in range(1500)]
    rows = [(i, " ".join(own(i)[:700] + (passage if i in (3, 50, 59) else []) + own(i)[700:])) for i in range(60)]
    assert sum(len(t.split()) for _, t in rows) > 2 * substrings.BLOCK_WORDS
    docs = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    got = {r["doc_id"]: r["removal"]["n_removed"] for r in substrings.remove_repeats(docs).collect()}
    assert {i for i, n in got.items() if n} == {50, 59} and got[50] == got[59] == 60
