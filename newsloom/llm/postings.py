"""Benchmark decontamination on a positional inverted index of the training texts.

The index has blocks of neighbouring documents. A block has a row for each of
its words, with the word's places as gaps, so the rows of a word over all blocks
are its posting list, and all that a match needs lies in one block. A query asks
for the posting lists of its words only, and meets them block by block: from
the rarest word on, lists are moved by the word's place in the phrase and
intersected. Queries go through in portions of a bounded size.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from newsloom.llm.lexing import Words, byte_classes, stable_order, utf8
from newsloom.llm.words import fresh
from newsloom.session import dealt_by, written

#: Bytes of text in a block of the index; a longer text is a block of its own.
BLOCK = 12 << 20
#: Queries, and bytes of their words, that go to the tasks at once.
QUERIES, QUERY_BYTES = 100_000, 16 << 20
#: Words are runs of letters, digits and non-ASCII characters.
CLASSES = byte_classes(bytes(b for b in range(128) if not chr(b).isalnum()))


def _gap_lists(places: np.ndarray, n: np.ndarray) -> Iterator[tuple[np.ndarray, pa.Array]]:
    """(lists, their gaps as bytes) for ascending places laid end to end; as many bytes to a gap as the list's widest takes."""
    first = np.cumsum(n) - n
    gaps = np.diff(places, prepend=0)
    gaps[first] = 0
    widest = np.maximum.reduceat(gaps, first)
    inner = np.ones(len(gaps), bool)
    inner[first] = False
    width = np.select([widest < 1 << 8, widest < 1 << 16], [1, 2], 4)
    for w in (1, 2, 4):
        lists = np.flatnonzero(width == w)
        if len(lists):
            mine = gaps[inner & np.repeat(width == w, n)].astype(f"<u{w}")
            offsets = np.concatenate([[0], np.cumsum((n[lists] - 1) * w)]).astype(np.int64)
            buffers = [None, pa.py_buffer(offsets), pa.py_buffer(mine.tobytes())]
            yield lists, pa.Array.from_buffers(pa.large_binary(), len(lists), buffers).cast(pa.binary())


def places_of(first: int, n: int, gaps: bytes) -> np.ndarray:
    out = np.zeros(n, np.int64)
    if n > 1:
        out[1:] = np.frombuffer(gaps, f"<u{len(gaps) // (n - 1)}")
    out[0] = first
    return np.cumsum(out)


def build_index(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The index as a table: `block`, `term`, `n`, `first`, `gaps`, `ordinal`, `key`.

    A row with a term has its `n` places in the block, the first and the gaps
    that follow; places count words from the block's start. A row with the
    empty term has the number of words of each document in the block. A row
    without a term is a document, with its number in the block, its number of
    words in `n` and its key.
    """
    kind = docs.schema[key].dataType
    rows = docs.select(F.col(key).alias("key"), F.col(text).alias("text"))
    schema = T.StructType.fromDDL("block long, term binary, n long, first long, gaps binary, ordinal int").add("key", kind)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        texts: list[bytes] = []
        keys: list[pa.Array] = []
        number, size = TaskContext.get().partitionId() << 32, 0

        def batch(key_type, *columns) -> pa.RecordBatch:
            block, term, n, first, gaps, ordinal, found = columns
            rows = len(n)
            arrays = [
                pa.array(np.full(rows, block)),
                pa.nulls(rows, pa.binary()) if term is None else term.cast(pa.binary()),
                pa.array(n, pa.int64()),
                pa.nulls(rows, pa.int64()) if first is None else pa.array(first, pa.int64()),
                pa.nulls(rows, pa.binary()) if gaps is None else gaps,
                pa.nulls(rows, pa.int32()) if ordinal is None else pa.array(ordinal, pa.int32()),
                pa.nulls(rows, key_type) if found is None else found,
            ]
            return pa.RecordBatch.from_arrays(arrays, schema.names)

        def flush() -> Iterator[pa.RecordBatch]:
            found = pa.concat_arrays(keys)
            words = Words(texts, CLASSES)
            lengths = np.bincount(words.text, minlength=len(texts))
            yield batch(found.type, number, None, lengths, None, None, np.arange(len(texts)), found)
            if len(words):
                counts = pa.array([lengths.astype("<u4").tobytes()], pa.binary())
                yield batch(found.type, number, pa.array([b""]), [len(texts)], [0], counts, None, None)
                codes, terms = words.encoded()
                n = np.bincount(codes, minlength=len(terms))
                places = stable_order(codes)
                first = places[np.cumsum(n) - n]
                for lists, gaps in _gap_lists(places, n):
                    for at in range(0, len(lists), 50_000):
                        part = lists[at : at + 50_000]
                        yield batch(found.type, number, terms.take(pa.array(part)), n[part], first[part], gaps.slice(at, len(part)), None, None)

        for each in batches:
            values, at = utf8(each.column(1)), 0
            for i, value in enumerate(values):
                texts.append(value)
                size += len(value)
                if size >= BLOCK:
                    keys.append(each.column(0).slice(at, i + 1 - at))
                    yield from flush()
                    texts, keys, size, at = [], [], 0, i + 1
                    number += 1
            if at < len(values):
                keys.append(each.column(0).slice(at))
        if texts:
            yield from flush()

    return written(rows.mapInArrow(run, schema), "postings")


def item_queries(items: DataFrame, key: str, text: str, window: int) -> DataFrame:
    """(`item`, `words`, `near`): each window of an item, and its whole text as a query for nearness."""
    rows = items.select(F.col(key).cast("string").alias("item"), F.col(text).alias("text"))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, value in enumerate(utf8(batch.column(1))):
                words = Words([value], CLASSES)
                codes, terms = words.encoded()
                n = len(words)
                if n:
                    length = min(window, n)
                    starts = np.arange(n - length + 1)
                    inside = starts[:, None] + np.arange(length)
                    offsets = np.arange(0, inside.size + 1, length)
                    offsets = np.append(offsets, inside.size + n).astype(np.int32)
                    flat = terms.cast(pa.binary()).take(pa.array(codes[np.append(inside.ravel(), np.arange(n))]))
                    lists = pa.ListArray.from_arrays(pa.array(offsets), flat)
                    item = batch.column(0).take(pa.array(np.full(len(lists), i)))
                    near = pa.array([False] * len(starts) + [True])
                    yield pa.RecordBatch.from_arrays([item, lists, near], ["item", "words", "near"])

    return rows.mapInArrow(run, "item string, words array<binary>, near boolean")


def portions(queries: DataFrame) -> Iterator[list]:
    """(id, words, near) rows a bounded number at a time."""
    held, size = [], 0
    for row in queries.select("id", "words", "near").toLocalIterator():
        held.append(row)
        size += sum(map(len, row.words))
        if len(held) >= QUERIES or size >= QUERY_BYTES:
            yield held
            held, size = [], 0
    if held:
        yield held


class Block:
    """The posting lists that a portion of queries asks of one block."""

    def __init__(self, lengths: np.ndarray, n_terms: int):
        self.ends = np.cumsum(lengths)
        self.starts = self.ends - lengths
        self.packed: dict[int, tuple[int, int, bytes]] = {}
        self.counts = np.zeros(n_terms, np.int64)
        self.known: dict[int, np.ndarray] = {}

    def add(self, term: int, first: int, n: int, gaps: bytes) -> None:
        self.packed[term] = first, n, gaps
        self.counts[term] = n

    def places(self, term: int) -> np.ndarray:
        if term not in self.known:
            first, n, gaps = self.packed[term]
            self.known[term] = places_of(first, n, gaps)
        return self.known[term]

    def document(self, places: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.starts, places, side="right") - 1

    def phrase(self, terms: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Starts and ends of the phrase, within documents."""
        order = np.argsort(self.counts[terms], kind="stable").tolist()
        found = self.places(int(terms[order[0]])) - order[0]
        for o in order[1:]:
            if not len(found):
                break
            others = self.places(int(terms[o]))
            at = np.searchsorted(others, found + o)
            found = found[others[np.minimum(at, len(others) - 1)] == found + o]
        found = found[found >= 0]
        inside = found + len(terms) <= self.ends[self.document(found)]
        return found[inside], found[inside] + len(terms)

    def near(self, terms: np.ndarray, reach: int) -> tuple[np.ndarray, np.ndarray]:
        """Starts and ends of the least stretches of at most `reach` words of a document that hold all the terms."""
        terms = terms[np.argsort(self.counts[terms], kind="stable")]
        rare = self.places(int(terms[0]))
        for t in terms[1:].tolist():
            if not len(rare):
                break
            others = self.places(t)
            at = np.minimum(np.searchsorted(others, rare - reach + 1), len(others) - 1)
            rare = rare[np.abs(others[at] - rare) < reach]
        if not len(rare):
            return rare, rare
        lists = []
        for t in terms.tolist():
            others = self.places(t)
            low, high = np.searchsorted(others, rare - reach + 1), np.searchsorted(others, rare + reach)
            low = np.maximum(low, np.maximum.accumulate(np.append(0, high[:-1])))
            n = np.maximum(high - low, 0)
            lists.append(others[np.repeat(low - np.cumsum(n) + n, n) + np.arange(n.sum())])
        ends = np.unique(np.concatenate(lists))
        starts = np.full(len(ends), np.iinfo(np.int64).max)
        for mine in lists:
            at = np.searchsorted(mine, ends, side="right") - 1
            starts = np.minimum(starts, np.where(at >= 0, mine[at], -1))
        holds = (starts >= 0) & (ends - starts < reach)
        starts, ends = starts[holds], ends[holds]
        same = self.document(starts) == self.document(ends)
        starts, ends = starts[same], ends[same]
        least = np.unique(starts, return_index=True)[1]
        return starts[least], ends[least] + 1


def _merged_spans(start: np.ndarray, end: np.ndarray) -> list[dict]:
    order = np.argsort(start, kind="stable")
    start, reach = start[order], np.maximum.accumulate(end[order])
    new = np.append(True, start[1:] > reach[:-1])
    last = np.append(np.flatnonzero(new)[1:] - 1, len(start) - 1)
    return [{"start": a, "end": b} for a, b in zip(start[new].tolist(), reach[last].tolist(), strict=True)]


_SPAN = pa.struct([("start", pa.int64()), ("end", pa.int64())])
_HITS = pa.schema([("block", pa.int64()), ("ordinal", pa.int32()), ("spans", pa.list_(_SPAN)), ("windows", pa.list_(pa.int64())), ("near", pa.list_(pa.int64()))])
HITS = "block long, ordinal int, spans array<struct<start:bigint,end:bigint>>, windows array<bigint>, near array<bigint>"


def matches(index: DataFrame, queries: list, reach: float) -> DataFrame:
    """`HITS` of a portion of queries: per document covered stretches, and the ids of phrases and of near queries found."""
    terms = sorted({w for q in queries for w in q.words})
    number = {w: i for i, w in enumerate(terms)}
    ids = np.array([q.id for q in queries])
    near = np.array([q.near for q in queries])
    flat = np.array([number[w] for q in queries for w in q.words], np.int32)
    ends = np.cumsum([len(q.words) for q in queries])
    asked = pa.table({"term": pa.array([b"", *terms], pa.binary()), "number": pa.array(range(-1, len(terms)), pa.int32())})
    small = asked.nbytes <= 2 * QUERY_BYTES
    asked = index.sparkSession.createDataFrame(asked)
    # A portion is bounded, but for one query longer than the bound; then Spark shuffles.
    asked = F.broadcast(asked) if small else asked
    rows = index.select("block", "term", "n", "first", "gaps").join(asked, "term").select("block", "number", "n", "first", "gaps")

    def evaluated(block: int, held: Block) -> pa.RecordBatch:
        found: list[tuple] = []
        present = np.minimum.reduceat(held.counts[flat] > 0, ends - np.diff(ends, prepend=0))
        for q in np.flatnonzero(present).tolist():
            mine = flat[ends[q - 1] if q else 0 : ends[q]]
            start, end = held.near(np.unique(mine), int(np.ceil(reach * len(mine)))) if near[q] else held.phrase(mine)
            if len(start):
                found.append((held.document(start), start, end, np.full(len(start), q)))
        if not found:
            return pa.RecordBatch.from_pylist([], _HITS)
        doc, start, end, which = (np.concatenate(x) for x in zip(*found, strict=True))
        out = []
        order = np.argsort(doc, kind="stable")
        for group in np.split(order, np.flatnonzero(np.diff(doc[order])) + 1):
            d, exact = int(doc[group[0]]), group[~near[which[group]]]
            at = held.starts[d]
            out.append(
                {
                    "block": block,
                    "ordinal": d,
                    "spans": _merged_spans(start[exact] - at, end[exact] - at) if len(exact) else [],
                    "windows": ids[np.unique(which[exact])].tolist(),
                    "near": ids[np.unique(which[group[near[which[group]]]])].tolist(),
                }
            )
        return pa.RecordBatch.from_pylist(out, _HITS)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, held = None, None
        for batch in batches:
            for b, t, n, first, gaps in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if b != block:
                    if held:
                        yield evaluated(block, held)
                    # The empty term sorts first and has the lengths of the documents.
                    block, held = b, Block(np.frombuffer(gaps, "<u4").astype(np.int64), len(terms))
                else:
                    held.add(t, first, n, gaps)
        if held:
            yield evaluated(block, held)

    return dealt_by(rows, "block").sortWithinPartitions("block", "number").mapInArrow(run, HITS)


def items_of(hits: DataFrame, column: str, owners: DataFrame) -> DataFrame:
    """(`set`, `items`): for each distinct array of query ids the items that own any of them, sorted as strings."""
    sets = hits.filter(F.size(column) > 0).groupBy(set_digest(F.col(column)).alias("set")).agg(F.first(column).alias("ids"))
    each = sets.select("set", F.explode("ids").alias("id")).join(owners, "id")
    return each.groupBy("set").agg(F.array_sort(F.collect_set("item")).alias("items"))


def set_digest(ids: Column) -> Column:
    return F.sha2(F.array_join(F.transform(ids, lambda i: i.cast("string")), ","), 256)


def covered_words(spans: Column) -> Column:
    """Number of places that any of the stretches covers."""
    zero = F.struct(F.lit(0).cast("long").alias("reach"), F.lit(0).cast("long").alias("n"))

    def step(state: Column, s: Column) -> Column:
        more = F.greatest(F.lit(0).cast("long"), s.end - F.greatest(state.reach, s.start))
        return F.struct(F.greatest(state.reach, s.end).alias("reach"), (state.n + more).alias("n"))

    return F.aggregate(F.array_sort(spans), zero, step, lambda s: s.n)


def benchmark_hits(
    docs: DataFrame,
    items: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    item_key: str = "item_id",
    item_text: str = "text",
    window: int = 10,
    reach: float = 2.0,
    index: DataFrame | None = None,
) -> DataFrame:
    """One row per row of `docs`: `key` and `hits`, what of the items it contains.

    `hits` has `n_words`; `spans`, the stretches of words that are an exact
    occurrence of `window` consecutive words of an item (of all its words, if
    it has fewer); `n_hit`, the words in these; `items`, the ids as strings,
    sorted, of items with such an occurrence; `near_items`, of those all of
    whose words stand in a stretch of at most `reach` times the item's length,
    in any order. Words are A-Z lower-cased runs of ASCII letters, digits and
    non-ASCII characters. Null texts have no words, items without words match
    nothing. Repeated rows each get a row; rows with one item id are one item.
    An item without an id hits words but is in no list. An empty `docs` gives
    no rows, an empty `items` no hits. Other columns are not read. A given
    `index` (see `build_index`) is used again.
    """
    index = build_index(docs, key, text) if index is None else index
    asked = written(item_queries(items, item_key, item_text, window), "benchmark-windows")
    queries = written(asked.groupBy("words", "near").agg(F.lit(1)).select(F.monotonically_increasing_id().alias("id"), "words", "near"), "benchmark-queries")
    owners = asked.filter("item is not null").alias("a").join(queries.alias("q"), ["words", "near"]).select("id", "item")
    owners = written(owners.distinct(), "benchmark-owners")
    spark = docs.sparkSession
    found = [written(matches(index, portion, reach), "benchmark-hits") for portion in portions(queries)]
    hits = spark.createDataFrame([], HITS)
    for more in found:
        hits = hits.unionByName(more)
    joined = [F.array_sort(F.flatten(F.collect_list(c))).alias(c) for c in ("spans", "windows", "near")]
    hits = written(hits.groupBy("block", "ordinal").agg(*joined), "benchmark-documents") if found else hits
    exact = items_of(hits, "windows", owners).select(F.col("set").alias("_exact"), F.col("items").alias("_items"))
    close = items_of(hits, "near", owners).select(F.col("set").alias("_close"), F.col("items").alias("_near_items"))
    hits = hits.join(exact, set_digest(F.col("windows")) == F.col("_exact"), "left")
    hits = hits.join(close, set_digest(F.col("near")) == F.col("_close"), "left").drop("windows", "near")
    none = F.array().cast("array<string>")
    rows = index.filter("term is null").select("block", "ordinal", "n", "key").join(hits, ["block", "ordinal"], "left")
    spans = F.coalesce("spans", F.array().cast("array<struct<start:bigint,end:bigint>>"))
    out = F.struct(
        F.col("n").alias("n_words"),
        covered_words(spans).alias("n_hit"),
        spans.alias("spans"),
        F.coalesce("_items", none).alias("items"),
        F.coalesce("_near_items", none).alias("near_items"),
    )
    return rows.select(F.col("key").alias(key), out.alias("hits" if key != "hits" else "_hits"))


def decontaminated(docs: DataFrame, items: DataFrame, key: str = "doc_id", **named) -> DataFrame:
    """The rows of `docs` whose key stands on no row that contains a window of an item; rows without a key stay.

    Columns are unchanged. The other arguments are those of `benchmark_hits`.
    """
    k = fresh(docs, "_hit_key")
    hits = benchmark_hits(docs, items, key, **named)
    gone = hits.filter(F.col(f"{hits.columns[-1]}.n_hit") > 0).select(F.col(key).alias(k)).distinct()
    return docs.join(written(gone, "benchmark-gone"), docs[key] == F.col(k), "left_anti")
