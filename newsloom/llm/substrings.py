"""Substring dedup on words by level-wise doubling.

A quarter of a window is the first length. Windows of that length are taken at
anchors that the content itself chooses, such that every full window holds one.
Those that another document has too are extended to twice the length, to
either side, and again to the full window; what is alone at one length is never
looked at again.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from newsloom.llm.runs import Hashes, anchored, covered, mixed
from newsloom.llm.words import fresh
from newsloom.session import written

#: Per group of windows that share an anchor: hashes of the anchor's run, of the run twice as
#: long to its left and right, and of all the windows together; first window, number of windows.
GROUPS = "doc long, content long, one long, two_left long, two_right long, whole long, first long, n long"


#: Words hashed together, and characters put together, by a task: each costs some tens of bytes more.
BLOCK_WORDS, BLOCK_CHARS = 1 << 15, 1 << 20


def split_words(text: str | None) -> list[bytes]:
    """Words between ASCII white space, as UTF-8."""
    return (text or "").encode(errors="surrogatepass").split()


def word_items(words: list[bytes]) -> np.ndarray:
    digest = xxhash.xxh3_64_intdigest
    return np.array([digest(w) for w in words], np.uint64)


def _signed(values: np.ndarray) -> pa.Array:
    return pa.array(values.astype(np.uint64).view(np.int64))


def _content(text: Column) -> Column:
    return F.xxhash64(F.coalesce(text, F.lit("")))


def window_groups(docs: DataFrame, key: str, text: str, window: int) -> DataFrame:
    """`GROUPS` for all documents with at least one window."""
    gram = -(-window // 4)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = 0
            while at < batch.num_rows:
                words, lengths, from_row = [], [], at
                while at < batch.num_rows and (not lengths or len(words) < BLOCK_WORDS):
                    mine = split_words(batch.column(1)[at].as_py())
                    words += mine
                    lengths.append(len(mine))
                    at += 1
                hashes = Hashes(word_items(words))
                first, n, anchor, which = anchored(hashes, np.array(lengths), window, gram)
                starts = np.concatenate([[0], np.cumsum(lengths)])
                left, right = np.maximum(anchor - gram, starts[which]), np.minimum(anchor + 2 * gram, starts[which + 1])
                whole = hashes.of(first, first + n + window - 1)
                whole = mixed(whole ^ ((anchor - first) * 1024 + n).astype(np.uint64))
                rows = which + from_row
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).take(pa.array(rows)),
                        batch.column(2).take(pa.array(rows)),
                        _signed(hashes.of(anchor, anchor + gram)),
                        _signed(hashes.of(left, anchor + gram)),
                        _signed(hashes.of(anchor, right)),
                        _signed(whole),
                        pa.array(first - starts[which]),
                        pa.array(n.astype(np.int64)),
                    ],
                    [c.split()[0] for c in GROUPS.split(", ")],
                )

    rows = docs.select(F.col(key).cast("long").alias("doc"), F.col(text).alias("text"), _content(F.col(text)).alias("content"))
    return rows.filter("doc is not null").mapInArrow(run, GROUPS)


def repeated(rows: DataFrame, by: list[str], name: str, *more: Column) -> DataFrame:
    """The keys that two documents or more have, with `_least`, the smallest of these; a table of its own.

    Keys combine in each task before they are shuffled. As a table it is a
    plain side of the joins that follow, so a key that very many documents
    have is split there.
    """
    keys = rows.groupBy(*by).agg(F.min("doc").alias("_least"), F.max("doc").alias("_most"), *more)
    keys = keys.filter("_least < _most").drop("_most")
    return written(keys.select(*[F.col(c).alias(f"_{c}") for c in by], *[c for c in keys.columns if c not in by]), name)


def _meet(rows: DataFrame, keys: DataFrame, by: list[str], how: str = "inner") -> DataFrame:
    on = F.lit(True)
    for c in by:
        on = on & (F.col(c) == F.col(f"_{c}"))
    return rows.join(keys, on, how)


def repeated_spans(docs: DataFrame, key: str, text: str, window: int) -> DataFrame:
    """(`doc`, `content`, `start`, `end`): stretches of words covered by windows that start in a smaller document too."""
    groups = written(window_groups(docs, key, text, window), "substring-groups")
    # Once the length: the anchors' runs.
    alive = _meet(groups, repeated(groups, ["one"], "substring-one"), ["one"], "left_semi")
    alive = written(alive, "substring-alive-one")
    # Twice the length, to the left or to the right: every full window holds one of the two.
    for side in ("two_left", "two_right"):
        pairs = repeated(alive, ["one", side], f"substring-{side}")
        pairs = pairs.select("_one", f"_{side}", F.lit(True).alias(f"_{side}_alive"))
        alive = _meet(alive, pairs, ["one", side], "left").drop("_one", f"_{side}")
    alive = alive.filter("_two_left_alive or _two_right_alive").drop("_two_left_alive", "_two_right_alive")
    alive = written(alive, "substring-alive-two")
    # The full length: all windows of an anchor at once where another document has just these,
    wholes = repeated_or_alone(alive)
    judged = written(_meet(alive, wholes, ["one", "whole"]).drop("_one", "_whole"), "substring-judged")
    end = F.col("first") + F.col("n") + (window - 1)
    spans = judged.filter("doc > _least").select("doc", "content", F.col("first").alias("start"), end.alias("end"))
    # and one by one where documents share some of an anchor's windows only.
    kinds = judged.groupBy("one").agg(F.min("whole").alias("_a"), F.max("whole").alias("_b")).filter("_a <> _b")
    kinds = written(kinds.select(F.col("one").alias("_one")), "substring-kinds")
    partly = _meet(judged.filter("doc = _least"), kinds, ["one"], "left_semi").select("doc", "content", "one", "first", "n")
    singles = written(single_windows(docs, partly, key, text, window), "substring-windows")
    twice = repeated(singles, ["one", "window"], "substring-twice")
    rest = _meet(singles, twice, ["one", "window"]).filter("doc > _least")
    rest = rest.select("doc", "content", F.col("place").alias("start"), (F.col("place") + window).alias("end"))
    return spans.unionByName(rest)


def repeated_or_alone(rows: DataFrame) -> DataFrame:
    """Each (`one`, `whole`) with its smallest document, be there one document or more."""
    least = rows.groupBy("one", "whole").agg(F.min("doc").alias("_least"))
    return written(least.select(F.col("one").alias("_one"), F.col("whole").alias("_whole"), "_least"), "substring-wholes")


def single_windows(docs: DataFrame, groups: DataFrame, key: str, text: str, window: int) -> DataFrame:
    """(`doc`, `content`, `one`, `window`, `place`) for each window of the groups, from the texts again.

    A row that is repeated is read once, and a group that several rows have is asked for once.
    """
    asked = groups.groupBy("doc", "content").agg(F.collect_set(F.struct("one", "first", "n")).alias("asked"))
    asked = asked.select(F.col("doc").alias("_doc"), F.col("content").alias("_same"), "asked")
    rows = docs.select(F.col(key).cast("long").alias("doc"), F.col(text).alias("text"), _content(F.col(text)).alias("content"))
    rows = rows.join(asked, (F.col("doc") == F.col("_doc")) & (F.col("content") == F.col("_same")))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                groups = batch.column(3)[i].values
                one, first, n = (groups.field(c).to_numpy(zero_copy_only=False) for c in ("one", "first", "n"))
                hashes = Hashes(word_items(split_words(batch.column(1)[i].as_py())))
                place = np.repeat(first - np.cumsum(n) + n, n) + np.arange(n.sum())
                size = len(place)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.full(size, batch.column(0)[i].as_py())),
                        pa.array(np.full(size, batch.column(2)[i].as_py())),
                        pa.array(np.repeat(one, n)),
                        _signed(hashes.of(place, place + window)),
                        pa.array(place),
                    ],
                    ["doc", "content", "one", "window", "place"],
                )

    # Behind the join, where few texts are left.
    rows = rows.select("doc", "text", "content", "asked").dropDuplicates(["doc", "content"])
    return rows.mapInArrow(run, "doc long, content long, one long, window long, place long")


def remove_repeats(docs: DataFrame, key: str = "doc_id", text: str = "text", window: int = 50) -> DataFrame:
    """All columns of `docs`, with the text rid of repeated words, and a last column `removal` of `n_words` and `n_removed`.

    A word goes if a window of `window` words covers it whose words also start
    in a document with a smaller key; windows are judged on the input. The
    kept words are joined by one space, also where nothing goes. Where `docs`
    has a column `removal` the new one gets underscores in front. Null texts
    have no words and stay null. A null key is never smaller, and its row is left whole.
    Rows with one key are one document: nothing in them is repeated from each
    other. An empty table gives no rows.
    """
    if window < 4:
        raise ValueError("a window has at least four words")
    spans = repeated_spans(docs, key, text, window)
    spans = spans.groupBy("doc", "content").agg(F.collect_set(F.struct("start", "end")).alias("spans"))
    d, c, s, r = (fresh(docs, x) for x in ("_doc", "_content", "_spans", "removal"))
    spans = written(spans.select(F.col("doc").alias(d), F.col("content").alias(c), F.col("spans").alias(s)), "substring-spans")
    rows = docs.join(spans, (docs[key].cast("long") == F.col(d)) & (_content(docs[text]) == F.col(c)), "left").drop(d, c)
    kinds = rows.schema
    place = rows.columns.index(text)
    result = rows.drop(s).withColumn(r, F.lit(None).cast("struct<n_words:bigint,n_removed:bigint>")).schema

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = 0
            while at < batch.num_rows:
                part, size = at, 0
                texts, n_words, n_removed = [], [], []
                while at < batch.num_rows and size < BLOCK_CHARS:
                    value = batch.column(place)[at].as_py()
                    words = split_words(value)
                    found = batch.column(len(kinds) - 1)[at]
                    gone = 0
                    total = len(words)
                    if found.is_valid:
                        spans = found.values
                        mask = covered(total, *(spans.field(x).to_numpy(zero_copy_only=False) for x in ("start", "end")))
                        gone = int(mask.sum())
                        words = [w for w, m in zip(words, mask.tolist(), strict=True) if not m]
                    kept = b" ".join(words).decode(errors="surrogatepass")
                    texts.append(None if value is None else kept)
                    n_words.append(total)
                    n_removed.append(gone)
                    size += len(kept)
                    at += 1
                columns = [batch.column(i).slice(part, at - part) for i in range(len(kinds) - 1)]
                columns[place] = pa.array(texts, pa.string())
                counts = pa.StructArray.from_arrays(
                    [pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64())], ["n_words", "n_removed"]
                )
                yield pa.RecordBatch.from_arrays([*columns, counts], result.names)

    return rows.mapInArrow(run, result)
