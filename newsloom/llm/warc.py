"""WARC archives of pages: one gzip member per record, read back sequentially.

The writer deals pages over tasks; each task streams its records into one
archive in a shared folder. The reader never holds an archive: it inflates a
block at a time, frames records by Content-Length and verifies each digest.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from urllib.parse import quote
from collections.abc import Iterable, Iterator
from datetime import UTC, datetime

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from newsloom.session import scratch_path, written

#: Lines of a record, as ISO 28500 has them.
VERSION = b"WARC/1.1"
VERSIONS = ("WARC/1.0", "WARC/1.1")
#: Characters that stand for themselves in an address, the percent sign with them.
ADDRESS = "%:/?#[]@!$&'()*+,;=-._~"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
BLOCK = 1 << 16

RECORD = (
    "archive string, offset long, page_id long, url string, record_type string, payload_digest string, "
    "payload_bytes long, refers_to long, payload binary"
)


def _sha256(data: bytes) -> str:
    return "sha256:" + hashlib.sha256(data).hexdigest()


def _name(page_id: int | None) -> str:
    return f"<urn:page:{'none' if page_id is None else page_id}>"


def _page(name: str | None) -> int | None:
    kind, _, value = (name or "").strip("<>").rpartition(":")
    return int(value) if kind == "urn:page" and value.removeprefix("-").isdecimal() else None


def record_bytes(page_id: int | None, url: str | None, payload: bytes, refers_to: str | None, date: str) -> bytes:
    """One record as a gzip member; a revisit has the HTTP head alone as its block.

    `WARC-Target-URI` has the address with what no address may hold encoded by
    percent signs; where that changes it, a field of its own keeps the text as it was.
    A page without an address has its record's name there.
    """
    head = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = head if refers_to else head + payload
    fields = [
        ("WARC-Type", "revisit" if refers_to else "response"),
        ("WARC-Record-ID", _name(page_id)),
        ("WARC-Date", date),
        ("Content-Type", "application/http; msgtype=response"),
        ("WARC-Payload-Digest", _sha256(payload)),
        ("WARC-Block-Digest", _sha256(block)),
        ("Content-Length", str(len(block))),
    ]
    own = _name(page_id).strip("<>")
    target = quote(url, safe=ADDRESS, errors="surrogatepass") if url else own
    fields.append(("WARC-Target-URI", target))
    if url is not None and (target != url or target == own):
        fields.append(("X-Target-Base64", base64.b64encode(url.encode(errors="surrogatepass")).decode()))
    if refers_to:
        fields += [("WARC-Refers-To", refers_to), ("WARC-Profile", PROFILE)]
    lines = b"".join(f"{k}: {v}\r\n".encode() for k, v in fields)
    packer = zlib.compressobj(6, zlib.DEFLATED, 31)
    return packer.compress(VERSION + b"\r\n" + lines + b"\r\n" + block + b"\r\n\r\n") + packer.flush()


def _fields(head: bytes) -> dict[str, str]:
    lines = head.decode(errors="replace").split("\r\n")
    if lines[0] not in VERSIONS:
        raise ValueError(f"not a WARC record: {lines[0][:40]!r}")
    return {k.lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:] if x)}


def _differs(digest: str | None, data: bytes) -> bool:
    """Whether a digest, as hex or base 32, is of an algorithm that is known here and not that of the data."""
    algorithm, _, value = (digest or "").partition(":")
    if algorithm.lower() not in ("sha1", "sha256", "md5"):
        return False
    own = hashlib.new(algorithm.lower(), data).digest()
    return value.lower() != own.hex() and value.upper().rstrip("=") != base64.b32encode(own).decode().rstrip("=")


def _target(fields: dict[str, str]) -> str | None:
    if "x-target-base64" in fields:
        return base64.b64decode(fields["x-target-base64"]).decode(errors="surrogatepass")
    target = (fields.get("warc-target-uri") or "").strip("<>")
    return None if target in ("", fields.get("warc-record-id", "").strip("<>")) else target


def members(stream) -> Iterator[tuple[int, bytes]]:
    """(offset, content) of each gzip member; the stream is read a block at a time."""
    offset = position = 0
    rest = b""
    while rest or (rest := stream.read(BLOCK)):
        inflate, parts = zlib.decompressobj(31), []
        while not inflate.eof:
            if not rest and not (rest := stream.read(BLOCK)):
                raise ValueError(f"the member at {offset} ends early")
            parts.append(inflate.decompress(rest))
            position += len(rest) - len(inflate.unused_data)
            rest = inflate.unused_data
        yield offset, b"".join(parts)
        offset = position


def records(stream) -> Iterator[dict]:
    """The responses and revisits of an archive in order; a wrong length or digest raises.

    Archives of other writers are read as well: records of other kinds are
    passed over, digests are optional, and a record whose name is no page's has
    no page_id. A response's payload digest is its SHA-256, whatever the archive has.
    """
    for offset, content in members(stream):
        end = content.index(b"\r\n\r\n") + 4
        fields = _fields(content[: end - 4])
        block = content[end : end + int(fields["content-length"])]
        if len(content) != end + len(block) + 4 or content[-4:] != b"\r\n\r\n":
            raise ValueError(f"record at {offset}: content length {fields['content-length']} does not frame it")
        if _differs(fields.get("warc-block-digest"), block):
            raise ValueError(f"record at {offset}: block digest differs")
        if fields["warc-type"] not in ("response", "revisit"):
            continue
        http, _, payload = block.partition(b"\r\n\r\n")
        revisit = fields["warc-type"] == "revisit"
        if not revisit and _differs(fields.get("warc-payload-digest"), payload):
            raise ValueError(f"record at {offset}: payload digest differs")
        stated = fields.get("warc-payload-digest", "").removeprefix("sha256:")
        told = [x.split(b":")[1].strip() for x in http.split(b"\r\n") if x.lower().startswith(b"content-length:")]
        yield {
            "offset": offset,
            "page_id": _page(fields.get("warc-record-id")),
            "url": _target(fields),
            "record_type": fields["warc-type"],
            "payload_digest": stated if revisit else hashlib.sha256(payload).hexdigest(),
            "payload_bytes": int(told[0]) if revisit and told else len(payload),
            "refers_to": _page(fields.get("warc-refers-to")) if revisit else None,
            "payload": None if revisit else payload,
        }


def mark_revisits(pages: DataFrame, least_bytes: int) -> DataFrame:
    """Pages with `_payload` and, for a revisit, `_original`: the smallest id with that payload."""
    payload = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    rows = pages.select("page_id", "url", payload.alias("_payload")).withColumn("_digest", F.sha2("_payload", 256))
    firsts = written(
        rows.filter(F.octet_length("_payload") >= least_bytes)
        .groupBy("_digest")
        .agg(F.min("page_id").alias("_first"), F.count("*").alias("_n"))
        .filter("_n > 1 and _first is not null")
        .select(F.col("_digest").alias("_repeated"), "_first"),
        "warc-firsts",
    )
    joined = rows.join(firsts, F.col("_digest") == F.col("_repeated"), "left")
    original = F.when(~F.col("page_id").eqNullSafe(F.col("_first")), F.col("_first"))
    return joined.select("page_id", "url", "_payload", original.alias("_original"))


def write_archives(pages: DataFrame, folder: str, least_bytes: int = 100, date: datetime | None = None) -> DataFrame:
    """Write `pages` (page_id, url, html) as archives; returns a table of `archive` and `n_records`.

    Each task writes under a name of its own attempt and moves the finished
    file to the name of its partition, so an attempt that is lost or repeated
    leaves one whole archive. Of the records with equal payloads of at least
    `least_bytes` the one with the smallest page_id is the response and the
    others are revisits of it; rows that repeat that page_id are responses
    too. Null html is an empty payload, a null page_id never an original.
    Other columns are not read. An empty table gives no archive.
    """
    stamp = (date or datetime.now(UTC)).strftime("%Y-%m-%dT%H:%M:%SZ")

    def write(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        store, root = fs.FileSystem.from_uri(folder)
        part = f"{root}/part-{TaskContext.get().partitionId():06d}.warc.gz"
        draft, out, n = f"{part}.{uuid.uuid4().hex}", None, 0
        for batch in batches:
            for row in batch.to_pylist():
                if out is None:
                    store.create_dir(root, recursive=True)
                    out = store.open_output_stream(draft, compression=None)
                first = row["_original"]
                out.write(record_bytes(row["page_id"], row["url"], row["_payload"], None if first is None else _name(first), stamp))
                n += 1
        if out is not None:
            out.close()
            store.move(draft, part)
            yield pa.RecordBatch.from_pylist([{"archive": part, "n_records": n}])

    return written(
        mark_revisits(pages, least_bytes).mapInArrow(write, "archive string, n_records long"), "warc-archives"
    )


def read_archives(spark: SparkSession, archives: DataFrame, folder: str) -> DataFrame:
    """The records of the archives, one row each (`RECORD`); `payload` is null for a revisit.

    Archives are dealt one to a task; a task holds a record and a block at a time.
    """
    schema = pa.schema(
        [
            ("archive", pa.string()), ("offset", pa.int64()), ("page_id", pa.int64()), ("url", pa.string()),
            ("record_type", pa.string()), ("payload_digest", pa.string()), ("payload_bytes", pa.int64()),
            ("refers_to", pa.int64()), ("payload", pa.binary()),
        ]
    )

    def read(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, _ = fs.FileSystem.from_uri(folder)
        for batch in batches:
            for path in batch.column("archive").to_pylist():
                held, n_bytes = [], 0
                with store.open_input_stream(path, compression=None) as stream:
                    for row in records(stream):
                        held.append(row | {"archive": path})
                        n_bytes += row["payload_bytes"]
                        if n_bytes > 1 << 22 or len(held) == 1000:
                            yield pa.RecordBatch.from_pylist(held, schema)
                            held, n_bytes = [], 0
                if held:
                    yield pa.RecordBatch.from_pylist(held, schema)

    n = max(1, archives.count())
    return archives.select("archive").repartition(n, "archive").mapInArrow(read, RECORD)


def archive_folder(spark: SparkSession) -> str:
    """A new folder for archives in the shared folder, as a URI."""
    path = scratch_path(spark, "warc")
    return path if "://" in path else f"file://{path}"
