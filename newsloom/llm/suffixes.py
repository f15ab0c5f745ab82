"""Suffix-array dedup on bytes: runs of sorted suffixes, front-coded, exchanged and merged by loser trees.

Not every suffix can repeat for a window's length. A first exchange of packed
numbers finds the anchors (runs of 16 bytes that the content chooses, such that
each window has one) which two documents share; only suffixes that start at
these are sorted. Such a suffix stands for all neighbouring windows with that
anchor: equal suffixes share all of them, and suffixes that follow each other
with the anchor in common are compared window by window.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from newsloom.llm.runs import Hashes, anchored, covered
from newsloom.llm.sorted_runs import LoserTree, decoded, front_coded, pack, unpack
from newsloom.llm.words import fresh
from newsloom.session import written

GRAM = 16
#: Bits of an anchor's hash that the first exchange compares; equal ones are candidates, no more.
BITS = 48
#: Bytes of text hashed at once, anchors packed at once, and keys sorted at once in a task.
BLOCK, PACKED, SORTED = 1 << 21, 1 << 20, 200_000
#: Bytes of all texts for each part of the exchanges.
PART = 16 << 20
#: Different keys of one anchor that are compared in memory; the windows of more are grouped by Spark.
HELD = 20_000

#: What tasks find: a covered stretch of a document, or a key whose windows are still to be grouped.
FOUND = "doc long, content long, start long, end long, last long, key binary"
_FOUND = {"doc": pa.int64(), "content": pa.int64(), "start": pa.int64(), "end": pa.int64(), "last": pa.int64(), "key": pa.binary()}


def text_bytes(text: str | None) -> bytes:
    return (text or "").encode(errors="surrogatepass")


def _content(text: Column) -> Column:
    return F.xxhash64(F.coalesce(text, F.lit("")))


def _batch(columns: dict, kinds: dict | None = None) -> pa.RecordBatch:
    return pa.RecordBatch.from_pydict(columns, schema=pa.schema(list(kinds.items())) if kinds else None)


def groups_of(data: list[bytes], window: int):
    """`anchored` of the texts, with places counted from the start of each text, and the anchors' hashes."""
    lengths = np.array([len(d) for d in data], np.int64)
    hashes = Hashes(np.frombuffer(b"".join(data), np.uint8).astype(np.uint64))
    first, n, anchor, which = anchored(hashes, lengths, window, GRAM)
    starts = (np.cumsum(lengths) - lengths)[which]
    return first - starts, n, anchor - starts, which, hashes.of(anchor, anchor + GRAM)


def shared_anchors(docs: DataFrame, window: int, parts: int) -> DataFrame:
    """(`doc`, `groups`): per document packed numbers of its groups whose anchor another document may have.

    A task tells at once what its own documents share, and sends such an
    anchor once, others as often as their document has them, as a few bytes
    each of a sorted, packed run. So an anchor in a third of all documents is
    one entry per run. Parts are decoded one after the other.
    """
    kinds = {"part": pa.int32(), "settled": pa.bool_(), "packed": pa.list_(pa.binary())}
    by_range = {"part": pa.int32(), "packed": pa.list_(pa.binary())}

    def by_document(doc: np.ndarray, group: np.ndarray) -> dict:
        """Documents and groups packed by part of the document, one row for each part."""
        order = np.lexsort((group, doc, doc % parts))
        doc, group = doc[order], group[order]
        cuts = np.searchsorted(doc % parts, np.arange(parts + 1))
        used = [p for p in range(parts) if cuts[p] < cuts[p + 1]]
        return {"part": used, "packed": [[pack(x[cuts[p] : cuts[p + 1]]) for x in (doc, group)] for p in used]}

    def local(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        n_held = 0

        def flush() -> Iterator[pa.RecordBatch]:
            h, doc, group = (np.concatenate([x[i] for x in held]) for i in range(3))
            order = np.lexsort((group, doc, h))
            h, doc, group = h[order], doc[order], group[order]
            begin = np.flatnonzero(np.diff(h, prepend=-1))
            end = np.append(begin[1:], len(h)) - 1
            several = np.repeat(doc[begin] != doc[end], end - begin + 1)
            if several.any():
                own = by_document(doc[several], group[several])
                yield _batch(own | {"settled": [True] * len(own["part"])}, kinds)
            sent = ~several
            sent[begin] = True
            h, doc, group = h[sent], doc[sent], group[sent]
            part = h % parts
            order = np.argsort(part, kind="stable")
            cuts = np.searchsorted(part[order], np.arange(parts + 1))
            rows = [order[a:b] for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
            packed = [[pack(np.diff(h[r], prepend=0)), pack(doc[r]), pack(group[r])] if len(r) else None for r in rows]
            used = [p for p in range(parts) if packed[p]]
            if used:
                yield _batch({"part": used, "settled": [False] * len(used), "packed": [packed[p] for p in used]}, kinds)

        for batch in batches:
            at = 0
            while at < batch.num_rows:
                data, keys, size = [], [], 0
                while at < batch.num_rows and size < BLOCK:
                    data.append(text_bytes(batch.column(1)[at].as_py()))
                    keys.append(batch.column(0)[at].as_py())
                    size += len(data[-1])
                    at += 1
                _, _, _, which, h = groups_of(data, window)
                if len(which):
                    ordinal = np.arange(len(which)) - np.searchsorted(which, which)
                    held.append(((h >> np.uint64(64 - BITS)).astype(np.int64), np.array(keys, np.int64)[which], ordinal))
                    n_held += len(which)
                if n_held >= PACKED:
                    yield from flush()
                    held, n_held = [], 0
        if held:
            yield from flush()

    def across(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, rows = None, []

        def found() -> Iterator[pa.RecordBatch]:
            h, doc, group = (np.concatenate([x[i] for x in rows]) for i in range(3))
            order = np.lexsort((doc, h))
            h, doc, group = h[order], doc[order], group[order]
            begin = np.flatnonzero(np.diff(h, prepend=-1))
            end = np.append(begin[1:], len(h)) - 1
            several = np.repeat(doc[begin] != doc[end], end - begin + 1)
            if several.any():
                yield _batch(by_document(doc[several], group[several]), by_range)

        for batch in batches:
            for i in range(batch.num_rows):
                p, settled = batch.column(0)[i].as_py(), batch.column(1)[i].as_py()
                if p != part and rows:
                    yield from found()
                    rows = []
                part = p
                values = [x.as_py() for x in batch.column(2)[i].values]
                if settled:
                    yield _batch({"part": [p], "packed": [values]}, by_range)
                else:
                    deltas, doc, group = map(unpack, values)
                    rows.append((np.cumsum(deltas), doc, group))
        if rows:
            yield from found()

    def together(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, rows = None, []

        def documents() -> pa.RecordBatch:
            doc, group = (np.concatenate([r[i] for r in rows]) for i in range(2))
            order = np.lexsort((group, doc))
            doc, group = doc[order], group[order]
            begin = np.flatnonzero(np.diff(doc, prepend=doc[0] - 1))
            groups = [pack(g) for g in np.split(group, begin[1:])]
            return _batch({"doc": doc[begin], "groups": groups}, {"doc": pa.int64(), "groups": pa.binary()})

        for batch in batches:
            for i in range(batch.num_rows):
                if (p := batch.column(0)[i].as_py()) != part and rows:
                    yield documents()
                    rows = []
                part = p
                rows.append([unpack(x.as_py()) for x in batch.column(1)[i].values])
        if rows:
            yield documents()

    sent = docs.select("doc", "text").mapInArrow(local, "part int, settled boolean, packed array<binary>")
    dealt = sent.repartitionById(parts, F.col("part")).sortWithinPartitions("part")
    found = dealt.mapInArrow(across, "part int, packed array<binary>")
    dealt = found.repartitionById(parts, F.col("part")).sortWithinPartitions("part")
    return dealt.mapInArrow(together, "doc long, groups binary")


def _rows(spans: list[tuple], keys: list[tuple] = ()) -> pa.RecordBatch:
    """`FOUND` rows from (doc, content, start, end), those that touch made one, and (doc, content, first, n, last, key)."""
    joined: list[list] = []
    for doc, content, start, end in sorted(spans):
        if joined and joined[-1][:2] == [doc, content] and start <= joined[-1][3]:
            joined[-1][3] = max(joined[-1][3], end)
        else:
            joined.append([doc, content, start, end])
    columns = [*zip(*[*((*j, None, None) for j in joined), *keys], strict=True)] or [()] * 6
    return _batch(dict(zip(_FOUND, map(list, columns), strict=True)), _FOUND)


def packed_text(rows: DataFrame, column: str) -> DataFrame:
    """The text column as compressed UTF-8, a third of what a shuffle would move; null stays null."""
    place = rows.columns.index(column)
    kinds = rows.withColumn(column, F.col(column).cast("binary")).schema

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = list(batch.columns)
            columns[place] = pa.array([packed_bytes(t.as_py()) for t in batch.column(place)], pa.binary())
            yield pa.RecordBatch.from_arrays(columns, batch.schema.names)

    return rows.mapInArrow(run, kinds)


def packed_bytes(text: str | None) -> bytes | None:
    if text is None:
        return None
    data = text_bytes(text)
    return len(data).to_bytes(8, "little") + (pa.compress(data, codec="zstd", asbytes=True) if data else b"")


def unpacked_bytes(data: bytes | None) -> bytes:
    size = int.from_bytes((data or b"")[:8], "little")
    return pa.decompress(data[8:], size, codec="zstd", asbytes=True) if size else b""


def group_runs(docs: DataFrame, asked: DataFrame, window: int, parts: int) -> DataFrame:
    """Sorted, front-coded runs of the suffixes at the asked groups' anchors, by part of the anchor's hash.

    A key is the text from the anchor to the end of the last window, then what
    lies between the first window's start and the anchor, and its length. If a
    run has a key from several documents, all but the smallest are settled
    here and only its own places are sent, so a passage that a third of all
    documents have is one document's entry per run. What is settled comes as
    stretches.
    """
    kinds = {"part": pa.int32(), "coded": pa.binary(), "members": pa.binary(), "spans": pa.binary()}

    def rows_of(entries: list[tuple]) -> pa.RecordBatch:
        spans, by_part = [], {}
        entries.sort()
        last, least, mine = None, None, None
        for key, doc, content, first, n, anchor in entries:
            if key != last:
                last, least, mine = key, doc, None
            if doc > least:
                spans.append((doc, content, first, first + n + window - 1))
            elif mine is not None and mine[2] == content and first - mine[5] <= window:
                # A key that comes again this near, as in a run of one character: its windows cover all between.
                mine[5] = first
            else:
                mine = [key, doc, content, first, n, first]
                by_part.setdefault(anchor % parts, []).append(mine)
        out = {"part": [], "coded": [], "members": [], "spans": []}
        for part, mine in by_part.items():
            out["part"].append(part)
            out["coded"].append(front_coded([e[0] for e in mine]))
            out["members"].append(pack(np.array([e[1:] for e in mine]).T.ravel()))  # doc, content, first, n, last
            out["spans"].append(None)
        if spans:
            settled = _rows(spans)
            out["part"].append(entries[0][5] % parts)
            out["coded"].append(None)
            out["members"].append(None)
            out["spans"].append(pack(np.concatenate([settled.column(i).to_numpy() for i in range(4)])))
        return _batch(out, kinds)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        entries: list[tuple] = []

        def found(rows: list[tuple]) -> Iterator[list[tuple]]:
            """Entries of some documents, in portions that fill the run."""
            texts = [r[0] for r in rows]
            first, n, anchor, which, h = groups_of(texts, window)
            begins = np.searchsorted(which, np.arange(len(rows) + 1))
            for (data, doc, content, asked), a, b in zip(rows, begins[:-1].tolist(), begins[1:].tolist(), strict=True):
                chosen = np.unique(unpack(asked))
                chosen = a + chosen[chosen < b - a]
                at = 0
                while at < len(chosen):
                    some = chosen[at : at + SORTED - len(entries)]
                    at += len(some)
                    for f, k, x, y in zip(*(v[some].tolist() for v in (first, n, anchor, h)), strict=True):
                        entries.append((data[x : f + k + window - 1] + data[f:x] + (x - f).to_bytes(2, "big"), doc, content, f, k, y))
                    if len(entries) >= SORTED:
                        yield rows_of(entries)
                        entries.clear()

        for batch in batches:
            at, columns = 0, [c.to_pylist() for c in batch.columns]
            while at < batch.num_rows:
                rows, size = [], 0
                while at < batch.num_rows and size < BLOCK:
                    doc, packed, content, asked = (c[at] for c in columns)
                    rows.append((unpacked_bytes(packed), doc, content, asked))
                    size += len(rows[-1][0])
                    at += 1
                yield from found(rows)
        if entries:
            yield rows_of(entries)

    asked = asked.select(F.col("doc").alias("_doc"), "groups")
    texts = packed_text(docs.select("doc", "text", "content"), "text")
    rows = texts.join(asked, F.col("doc") == F.col("_doc")).select("doc", "text", "content", "groups")
    return rows.mapInArrow(run, "part int, coded binary, members binary, spans binary")


def whole_of(key: bytes) -> bytes:
    """The text of a key's windows, from the first one's start."""
    left = int.from_bytes(key[-2:], "big")
    return key[len(key) - 2 - left : -2] + key[: len(key) - 2 - left]


def settle(keys: list[tuple[bytes, list]], window: int) -> list[tuple]:
    """Stretches for the ascending different keys of one anchor with their (doc, content, first, n, last)."""
    if len(keys) < 2 and (not keys or len(keys[0][1]) == 1):
        return []
    spans, own = [], []
    for key, members in keys:
        least = min(m[0] for m in members)
        spans += [(d, c, f, last + n + window - 1) for d, c, f, n, last in members if d > least]
        own.append((whole_of(key), least, [m for m in members if m[0] == least]))
    if len(own) > 1:
        lowest: dict[bytes, int] = {}
        for whole, doc, members in own:
            for i in range(members[0][3]):
                x = whole[i : i + window]
                if lowest.get(x, doc) >= doc:
                    lowest[x] = doc
        for whole, doc, members in own:
            hits = [i for i in range(members[0][3]) if lowest[whole[i : i + window]] < doc]
            spans += [(doc, c, f + i, last + i + window) for _, c, f, _, last in members for i in hits]
    return spans


def merged(runs: DataFrame, window: int, parts: int) -> DataFrame:
    """`FOUND`: the runs of each part merged by a loser tree, equal keys and shared windows settled per anchor.

    Keys of one anchor share its bytes and come one after the other. Of an
    anchor with more than `HELD` different keys all are passed on.
    """

    def merge(held: list[tuple[bytes, np.ndarray]]) -> Iterator[pa.RecordBatch]:
        members = [m.reshape(5, -1).T.tolist() for _, m in held]
        at = [0] * len(held)
        spans: list[tuple] = []
        passed: list[tuple] = []
        keys: list[tuple[bytes, list]] = []
        many = False

        def pass_on() -> None:
            passed.extend((*m, key) for key, some in keys for m in some)
            keys.clear()

        for run, key, shared in LoserTree([decoded(coded) for coded, _ in held]):
            if shared < GRAM:
                if many:
                    pass_on()
                spans += settle(keys, window)
                keys, many = [], False
            if keys and key == keys[-1][0]:
                keys[-1][1].append(members[run][at[run]])
            else:
                if len(keys) >= HELD:
                    many = True
                    pass_on()
                keys.append((key, [members[run][at[run]]]))
            at[run] += 1
            if len(spans) + len(passed) > 100_000:
                yield _rows(spans, passed)
                spans, passed = [], []
        if many:
            pass_on()
        yield _rows([*spans, *settle(keys, window)], passed)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, held = None, []
        for batch in batches:
            for r in batch.to_pylist():
                if r["part"] != part and held:
                    yield from merge(held)
                    held = []
                part = r["part"]
                if r["spans"] is not None:
                    doc, content, start, end = unpack(r["spans"]).reshape(4, -1)
                    none = [None] * len(doc)
                    yield _batch({"doc": doc, "content": content, "start": start, "end": end, "last": none, "key": none}, _FOUND)
                else:
                    held.append((r["coded"], unpack(r["members"])))
        if held:
            yield from merge(held)

    dealt = runs.repartitionById(parts, F.col("part")).sortWithinPartitions("part")
    return dealt.mapInArrow(run, FOUND)


def single_windows(keys: DataFrame, window: int) -> DataFrame:
    """(`doc`, `content`, `start`, `last`, `window`): each window of the passed keys; `start` and `end` hold first and number."""
    kinds = pa.schema([("doc", pa.int64()), ("content", pa.int64()), ("start", pa.int64()), ("last", pa.int64()), ("window", pa.binary())])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for r in batch.to_pylist():
                whole = whole_of(r["key"])
                for i in range(r["end"]):
                    place = {"start": r["start"] + i, "last": r["last"] + i, "window": whole[i : i + window]}
                    rows.append({"doc": r["doc"], "content": r["content"], **place})
            yield pa.RecordBatch.from_pylist(rows, kinds)

    return keys.mapInArrow(run, "doc long, content long, start long, last long, window binary")


def same_texts(docs: DataFrame) -> tuple[DataFrame, int]:
    """(`doc`, `content`, `n_bytes`) of the documents whose whole text a smaller document has too, and the bytes of all."""
    text = F.coalesce("text", F.lit(""))
    rows = docs.select("doc", "content", F.sha2(text, 256).alias("digest"), F.octet_length(text).cast("long").alias("n_bytes"))
    rows = written(rows, "suffix-contents")
    least = rows.groupBy("digest").agg(F.min("doc").alias("_least"), F.max("doc").alias("_most")).filter("_least < _most")
    least = written(least.select(F.col("digest").alias("_digest"), "_least"), "suffix-same")
    later = rows.join(least, F.col("digest") == F.col("_digest")).filter("doc > _least")
    return written(later.select("doc", "content", "n_bytes").distinct(), "suffix-copies"), rows.agg(F.sum("n_bytes")).first()[0] or 0


def repeated_spans(docs: DataFrame, window: int) -> DataFrame:
    """(`doc`, `content`, `start`, `end`) of bytes covered by windows that start in a smaller document too.

    A document whose whole text a smaller one has goes as a whole, and what it
    would take from others that one takes: the search is over the rest.
    """
    copies, size = same_texts(docs)
    columns = ("doc", "content", "start", "end")
    whole = copies.filter(F.col("n_bytes") >= window).select("doc", "content", F.lit(0).cast("long").alias("start"), F.col("n_bytes").alias("end"))
    docs = docs.join(copies, ["doc", "content"], "left_anti").select("doc", "text", "content")
    parts = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-size // PART))
    groups = written(shared_anchors(docs, window, parts), "suffix-shared")
    found = written(merged(group_runs(docs, groups, window, parts), window, parts), "suffix-found")
    spans = found.filter("key is null").select(*columns).unionByName(whole)
    passed = found.filter("key is not null")
    if passed.isEmpty():
        return spans
    singles = written(single_windows(passed, window), "suffix-windows")
    least = singles.groupBy("window").agg(F.min("doc").alias("_least"), F.max("doc").alias("_most")).filter("_least < _most")
    least = written(least.select(F.col("window").alias("_window"), "_least"), "suffix-least")
    rest = singles.join(least, F.col("window") == F.col("_window")).filter("doc > _least")
    return spans.unionByName(rest.select("doc", "content", "start", (F.col("last") + window).alias("end")))


def remove_repeats(docs: DataFrame, key: str = "doc_id", text: str = "text", window: int = 50) -> DataFrame:
    """All columns of `docs` but the text, and a last column `removal`.

    `removal` has `n_bytes`, `n_removed`, `n_spans` (removed runs), `spans`
    (their places as start and end), `kept` (the remaining bytes) and
    `kept_sha256`. A byte of the UTF-8 text goes if a string of `window` bytes
    covers it that also starts in a document with a smaller key; strings are
    judged on the input and may overlap. Null texts are empty. A null key is
    never smaller, and its row is left whole. Rows with one key are one
    document. An empty table gives no rows. Where `docs` has a column
    `removal` the new one gets underscores in front.
    """
    if not 2 * GRAM <= window < 1 << 15:
        raise ValueError(f"a window has from {2 * GRAM} to 32767 bytes")
    named = docs.select(F.col(key).cast("long").alias("doc"), F.col(text).alias("text"), _content(F.col(text)).alias("content"))
    spans = repeated_spans(named.filter("doc is not null"), window)
    spans = spans.groupBy("doc", "content").agg(F.collect_set(F.struct("start", "end")).alias("spans"))
    d, c, s, t, m, r = (fresh(docs, x) for x in ("_doc", "_content", "_spans", "_text", "_mine", "removal"))
    spans = written(spans.select(F.col("doc").alias(d), F.col("content").alias(c), F.col("spans").alias(s)), "suffix-spans")
    others = [x for x in docs.columns if x != text]
    own = docs.select(*others, F.col(text).alias(t), _content(F.col(text)).alias(m))
    packed = packed_text(own, t)
    rows = packed.join(spans, (packed[key].cast("long") == F.col(d)) & (F.col(m) == F.col(c)), "left").select(*others, t, s)
    kind = "struct<n_bytes:bigint,n_removed:bigint,n_spans:bigint,spans:array<struct<start:bigint,end:bigint>>,kept:binary,kept_sha256:string>"
    result = docs.select(*others, F.lit(None).cast(kind).alias(r)).schema
    span = pa.struct([("start", pa.int64()), ("end", pa.int64())])
    struct = pa.struct(
        [("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("spans", pa.list_(span)), ("kept", pa.binary()), ("kept_sha256", pa.string())]
    )

    def removal(packed: bytes | None, spans) -> dict:
        data, out = unpacked_bytes(packed), []
        kept = data
        if spans is not None:
            mask = covered(len(data), *(spans.field(x).to_numpy(zero_copy_only=False) for x in ("start", "end")))
            edges = np.flatnonzero(np.diff(mask, prepend=False, append=False))
            out = [{"start": a, "end": b} for a, b in edges.reshape(-1, 2).tolist()]
            kept = np.frombuffer(data, np.uint8)[~mask].tobytes()
        digest = hashlib.sha256(kept).hexdigest()
        return {"n_bytes": len(data), "n_removed": len(data) - len(kept), "n_spans": len(out), "spans": out, "kept": kept, "kept_sha256": digest}

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, texts, found = 0, batch.column(len(others)), batch.column(len(others) + 1)
            while at < batch.num_rows:
                begin, rows, size = at, [], 0
                while at < batch.num_rows and size < 1 << 23:
                    rows.append(removal(texts[at].as_py(), found[at].values if found[at].is_valid else None))
                    size += rows[-1]["n_bytes"]
                    at += 1
                columns = [batch.column(i).slice(begin, at - begin) for i in range(len(others))]
                yield pa.RecordBatch.from_arrays([*columns, pa.array(rows, struct)], result.names)

    return rows.mapInArrow(run, result)
