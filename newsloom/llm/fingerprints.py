"""Document fingerprints by content-defined chunking.

A gear hash over the last 32 bytes cuts a text where the content says so, with
a strict mask before the usual size and a loose one after it (normalised
chunking). A fingerprint is the set of its chunks' digests, each with the
chunk's length, so an insertion changes the chunks around it alone, and the
lengths of shared chunks measure how much of one text is contained in another.
"""

from __future__ import annotations

import base64
import hashlib
import math
from bisect import bisect_left
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Chunk sizes in bytes. The least size is the reach of the hash, so a cut depends on its own chunk alone.
LEAST, USUAL, MOST = 32, 48, 192
#: One position in 64 passes the strict mask, one in 16 the loose one; high bits depend on all 32 bytes.
STRICT, LOOSE = np.uint32(0xFC000000), np.uint32(0xF0000000)
GEAR = np.array([xxhash.xxh32_intdigest(bytes([b]), 3) for b in range(256)], np.uint32)


def gear_hashes(data: np.ndarray) -> np.ndarray:
    """At each byte, the sum of gear values shifted by age, of the last 32 bytes; five doublings."""
    h = GEAR[data]
    for step in (1, 2, 4, 8, 16):
        if step < len(h):
            older = h[:-step] << np.uint32(step)
            h[step:] += older
    return h


def cuts(data: bytes) -> list[int]:
    """The ends of the chunks, in order; none for empty data."""
    h = gear_hashes(np.frombuffer(data, np.uint8))
    loose = np.flatnonzero((h & LOOSE) == 0)
    strict = loose[(h[loose] & STRICT) == 0].tolist()
    loose, start, size, out = loose.tolist(), 0, len(data), []
    while start < size:
        end = min(start + MOST, size)
        k = bisect_left(strict, start + LEAST - 1)
        if k < len(strict) and strict[k] < min(start + USUAL - 1, end):
            end = strict[k] + 1
        else:
            k = bisect_left(loose, start + USUAL - 1)
            if k < len(loose) and loose[k] < end:
                end = loose[k] + 1
        out.append(end)
        start = end
    return out


def chunk_set(data: bytes, ends: list[int], start: int = 0) -> set[int]:
    """48 bits of digest above 16 of length, for each distinct chunk."""
    digest, out = xxhash.xxh3_64_intdigest, set()
    for end in ends:
        out.add((digest(data[start:end]) & ~0xFFFF) | (end - start))
        start = end
    return out


def as_text(chunks: set[int]) -> str:
    """The fingerprint: sorted chunk numbers, big-endian, in base64."""
    return base64.b64encode(np.array(sorted(chunks), ">u8").tobytes()).decode()


def from_text(fingerprint: str) -> set[int]:
    return set(np.frombuffer(base64.b64decode(fingerprint), ">u8").tolist())


def containment(a: set[int], b: set[int]) -> float:
    """The share of `a`, by length of its distinct chunks, that `b` has too; 1 for two empty sets."""
    if not a:
        return 0.0 if b else 1.0
    return sum(x & 0xFFFF for x in a & b) / sum(x & 0xFFFF for x in a)


def edited(text: str, following: str) -> tuple[str, str]:
    """The text without its last quarter, and what replaces that: as much from the start of the following."""
    n = len(text) // 4
    return text[: len(text) - n], following[:n]


OUT = "_key long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


class _Document:
    """A text with its bytes, cuts and chunks, while its follower is awaited."""

    def __init__(self, key: int | None, text: str):
        self.key, self.text, self.data = key, text, text.encode()
        self.ends = cuts(self.data)
        self.chunks = chunk_set(self.data, self.ends)

    def row(self, following: _Document | None) -> tuple:
        kept, new = edited(self.text, following.text if following else "")
        data = (head := kept.encode()) + new.encode()
        # A cut depends on nothing behind it: chunks that end within the kept part stay.
        n = bisect_left(self.ends, len(head) + 1)
        start = self.ends[n - 1] if n else 0
        tail = data[start:]
        other = chunk_set(data, self.ends[:n]) | chunk_set(tail, cuts(tail))
        return (
            self.key,
            len(self.text),
            hashlib.sha256(data).hexdigest(),
            as_text(self.chunks),
            as_text(other),
            containment(self.chunks, other),
            containment(self.chunks, following.chunks if following else set()),
        )


def key_ranges(docs: DataFrame, key: str, n: int) -> list[int]:
    """At most `n` keys of the table, ascending from its smallest, that split it into ranges of like size."""
    steps = [i / n for i in range(n)]
    found = docs.agg(F.percentile_approx(key, steps, 20 * n)).first()[0] or []
    least = docs.agg(F.min(key)).first()[0]
    return sorted({*found, *([] if least is None else [least])})


def fingerprints(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per document: `key`, `n_chars`, `edited_sha256`, `fingerprint`, `edited_fingerprint`, `near_edited`, `near_next`.

    The edited text has its last quarter replaced by the start of the next
    document in ascending order of the integer key, the first one after the
    last. `near_edited` and `near_next` are the shares of the document that
    the edited text and the next document contain.

    Documents are dealt by key range, four ranges to a shuffle partition, and
    the first document of each range goes to the range before it as well;
    tasks then stream through their ranges in order and hold two documents.
    Equal keys are ordered by text. A null text counts as empty. A row with a
    null key has no place in the order: its next text is empty. An empty
    table gives no rows. Other columns are not read.
    """
    spark = docs.sparkSession
    starts = key_ranges(docs, key, 4 * int(spark.conf.get("spark.sql.shuffle.partitions")))
    rows = docs.select(F.col(key).cast("long").alias("k"), F.coalesce(F.col(text), F.lit("")).alias("t"))
    n = max(len(starts), 1)
    width = math.isqrt(n - 1) + 1
    groups = [starts[i : i + width] for i in range(0, n, width)] or [[0]]
    at_most = lambda values, k: F.size(F.filter(values, lambda s: s <= k))
    longs = lambda values: F.lit(values).cast("array<bigint>")
    group = at_most(longs([g[0] for g in groups if g]), F.col("k")) - 1
    rows = rows.withColumn("g", group).withColumn("s", F.get(F.array(*map(longs, groups)), F.col("g")))
    place = F.col("g") * width + at_most(F.col("s"), F.col("k")) - 1
    own = F.struct(F.coalesce(place, F.lit(n)).alias("b"), F.lit(False).alias("h"))
    before = F.struct(((place + n - 1) % n).alias("b"), F.lit(True).alias("h"))
    places = F.when(F.array_contains("s", F.col("k")), F.array(own, before)).otherwise(F.array(own))
    dealt = rows.select("k", "t", F.explode(places).alias("p")).select("k", "t", "p.b", "p.h")
    # Rows without a key don't depend on each other; their text deals them.
    dealt = dealt.repartition("b", F.when(F.col("k").isNull(), F.xxhash64("t"))).sortWithinPartitions("b", "h", "k", "t")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: _Document | None = None
        bucket, closed, out, size = None, True, [], 0

        def batch() -> pa.RecordBatch:
            columns = list(zip(*out, strict=True))
            kinds = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64())
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names)

        for rows in batches:
            for k, t, b, h in zip(*(rows.column(i) for i in range(4)), strict=True):
                b, h = b.as_py(), h.as_py()
                if b == bucket and closed and h:
                    continue  # further rows of the next range's first key
                document = _Document(k.as_py(), t.as_py())
                if document.key is None:
                    out.append(document.row(None))
                elif b == bucket and not closed:
                    out.append(waiting.row(document))
                bucket, closed, waiting = b, h or document.key is None, document
                size += len(document.data)
                if out and (size > 1 << 23 or len(out) == 2000):
                    yield batch()
                    out, size = [], 0
        if out:
            yield batch()

    names = [x.strip().split()[0] for x in OUT.split(",")]
    result = dealt.mapInArrow(run, OUT)
    return result.withColumnRenamed("_key", key)
