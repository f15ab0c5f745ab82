"""SentencePiece encoding and decoding by suffix-array matching.

The distinct stretches of a batch that no piece crosses are laid end to end and
indexed by a suffix array. Every piece is searched in it, and what it finds are
edges from one place of the text to another. Edges are relaxed in the order of
the places they end at: a place's token is the one whose boundary with the token
before it holds under the merge order, and there is just one. That is the
byte-pair encoding, without a merge ever being carried out on the text.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from newsloom.llm.lexing import stable_order
from newsloom.llm.words import fresh

SPACE = "▁"
#: Characters of text that a task encodes at once; a longer text goes alone.
TEXTS = 1 << 23


@dataclass
class Pieces:
    """A byte-pair model with byte fallback: pieces, merge ranks, and which pairs of pieces merge."""

    texts: list[bytes]  #: by id; the one past the last stands for any character without a piece
    decoded: list[bytes]  #: what an id gives back
    ids: np.ndarray  #: ids that can occur, in the order of `texts` sorted
    rank: np.ndarray  #: lower merges first; -1 for single characters
    left: np.ndarray  #: the two pieces that an id is merged from; itself for a single character
    right: np.ndarray
    pairs: np.ndarray  #: left * n + right of all pairs whose union is a piece, ascending
    pair_rank: np.ndarray
    byte_ids: np.ndarray
    first: np.ndarray  #: of each of `ids` the first 8 bytes as a number, filled up with zero bytes,
    past: np.ndarray  #: and with the highest ones
    parts: dict  #: of those with more bytes: the numbers of the following ones

    @property
    def unknown(self) -> int:
        return len(self.texts) - 1


def _merge(symbols: list[str], score: dict[str, float]) -> list[tuple[str, str]]:
    """The merges, in order, of symbols into pieces: best score first, then leftmost."""
    merges = []
    while len(symbols) > 1:
        found = [(-score[a + b], i) for i, (a, b) in enumerate(zip(symbols, symbols[1:], strict=False)) if a + b in score]
        if not found:
            break
        i = min(found)[1]
        merges.append((symbols[i], symbols[i + 1]))
        symbols = [*symbols[:i], symbols[i] + symbols[i + 1], *symbols[i + 2 :]]
    return merges


def load(path: str) -> Pieces:
    """The tables of a `.model` file. A model of another kind than this encoder is made for raises.

    Asked for are byte-pair merges, byte fallback, no normalisation besides
    the leading space, a piece for each character of a piece, and no piece
    with a space behind another character.
    """
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    n = model.get_piece_size()
    texts = [model.id_to_piece(i) for i in range(n)]
    special = [model.is_byte(i) or model.is_control(i) or model.is_unknown(i) or model.is_unused(i) for i in range(n)]
    score = {t: model.get_score(i) for i, t in enumerate(texts) if not special[i]}
    number = {t: i for i, t in enumerate(texts) if not special[i]}
    byte_ids = np.full(256, -1, np.int64)
    for i in range(n):
        if model.is_byte(i):
            byte_ids[int(texts[i][3:-1], 16)] = i
    if (byte_ids < 0).any() or any(SPACE in t.lstrip(SPACE) for t in score) or any(c not in score for t in score for c in t):
        raise ValueError(f"{path} is not a byte-pair model with byte fallback as asked for")
    order = {s: r for r, s in enumerate(sorted({-s for s in score.values()}))}
    rank, left, right = np.full(n + 1, -1, np.int64), np.arange(n + 1), np.arange(n + 1)
    pairs: dict[int, int] = {}
    reachable = []
    for t, i in number.items():
        r = order[-score[t]]
        for k in range(1, len(t)):
            if t[:k] in number and t[k:] in number:
                pairs[number[t[:k]] * (n + 1) + number[t[k:]]] = r
        merges = _merge(list(t), score) if len(t) > 1 else []
        if len(t) == 1 or len(merges) == len(t) - 1:
            reachable.append(i)
        if merges and len(merges) == len(t) - 1:
            rank[i], left[i], right[i] = r, number[merges[-1][0]], number[merges[-1][1]]
    keys = np.array(sorted(pairs), np.int64)
    decoded = [b"" if special[i] else t.replace(SPACE, " ").encode() for i, t in enumerate(texts)]
    for b, i in enumerate(byte_ids):
        decoded[i] = bytes([b])
    coded = [t.encode() for t in texts] + [b""]
    ids = np.array(sorted(reachable, key=lambda i: coded[i]), np.int64)
    tables = Pieces(
        coded, [*decoded, b""], ids, rank, left, right, keys, np.array([pairs[k] for k in keys.tolist()], np.int64), byte_ids,
        _eights(coded, ids, b"\0"), _eights(coded, ids, b"\xff"),
        {
            j: [tuple(np.uint64(_number(coded[i][at : at + 8], fill)) for fill in (b"\0", b"\xff")) for at in range(8, len(coded[i]), 8)]
            for j, i in enumerate(ids.tolist())
            if len(coded[i]) > 8
        },
    )
    probe = "  A probe:\ttwo  spaces, é 中\U0001f600 ﬁ 12345 <s>\n"
    if encode(tables, [probe])[0].tolist() != model.encode(probe):
        raise ValueError(f"{path} encodes otherwise than this encoder")
    return tables


def _number(part: bytes, fill: bytes) -> int:
    return int.from_bytes(part.ljust(8, fill), "big")


def _eights(coded: list[bytes], ids: np.ndarray, fill: bytes) -> np.ndarray:
    return np.array([_number(coded[i][:8], fill) for i in ids.tolist()], np.uint64)


def suffix_array(text: np.ndarray, starts: np.ndarray, reach: int) -> tuple[np.ndarray, list[np.ndarray]]:
    """`starts` in the order of what follows them, up to a zero byte or `reach` bytes, and sort keys of 8 bytes each.

    The first eight bytes sort all; later ones sort only what is still tied
    and has not ended.
    """
    padded = np.concatenate([text, np.zeros(reach + 16, np.uint8)]).astype(np.uint64)
    eight = np.zeros(len(padded) - 7, np.uint64)
    open_ = np.ones(len(eight), bool)
    for i in range(8):
        byte = padded[i : len(eight) + i]
        open_ &= byte != 0
        eight |= np.where(open_, byte, 0) << np.uint64(56 - 8 * i)
    goes_on = open_  # no end within these eight bytes
    order = starts[np.argsort(eight[starts], kind="stable")]
    keys = [eight[order]]
    alive = goes_on[order]
    tied = np.zeros(len(order), np.int64)
    if len(order):
        tied[1:] = np.cumsum(keys[0][1:] != keys[0][:-1])
    for depth in range(8, reach, 8):
        key = np.zeros(len(order), np.uint64)
        some = np.flatnonzero(alive)
        if len(some):
            later = eight[order[some] + depth]
            ranked = np.lexsort((later, tied[some]))
            order[some] = order[some[ranked]]
            key[some] = later[ranked]
            alive[some] = goes_on[order[some] + depth]
            step = np.zeros(len(order), np.int64)
            step[1:] = (tied[1:] != tied[:-1]) | (key[1:] != key[:-1])
            tied = np.cumsum(step)
        keys.append(key)
    return order, keys


def occurrences(tables: Pieces, keys: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """For each of `tables.ids` the range of the suffix array that starts with its text, by binary search."""
    low = np.searchsorted(keys[0], tables.first, "left")
    high = np.searchsorted(keys[0], tables.past, "right")
    for j, parts in tables.parts.items():
        a, b = int(low[j]), int(high[j])
        for depth, (least, most) in enumerate(parts, 1):
            if a == b:
                break
            span = keys[depth][a:b]
            a, b = a + int(np.searchsorted(span, least)), a + int(np.searchsorted(span, most, "right"))
        low[j], high[j] = a, b
    return low, high


def holds(tables: Pieces, before: np.ndarray, after: np.ndarray) -> np.ndarray:
    """Whether two tokens can stand side by side: no merge across their border comes before their own.

    Merges are undone from the latest back. While two parts face each other, a
    merge of the two must not rank before the merge that ends their time:
    strictly before it on the left side, where ties go to the left, or equal
    with it on the right side.
    """
    a, b = before.copy(), after.copy()
    good = np.ones(len(a), bool)
    until = np.full(len(a), np.iinfo(np.int64).max)
    some = np.arange(len(a))
    while len(some):
        x, y = a[some], b[some]
        key = x * len(tables.texts) + y
        at = np.minimum(np.searchsorted(tables.pairs, key), len(tables.pairs) - 1)
        meets = (tables.pairs[at] == key) & (tables.pair_rank[at] < until[some])
        good[some[meets]] = False
        p, q = tables.rank[x], tables.rank[y]
        # Of equal ranks the left one was merged first, so the right one is undone first.
        go_left = p > q
        until[some] = np.where(go_left, p, q + 1)
        a[some] = np.where(go_left, tables.right[x], x)
        b[some] = np.where(go_left, y, tables.left[y])
        some = some[~meets & (np.maximum(p, q) >= 0)]
    return good


def encode_stretches(tables: Pieces, coded: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(ids of all stretches in order, number of ids of each); no piece crosses from one to another."""
    sizes = np.array([len(c) for c in coded], np.int64)
    text = np.frombuffer(b"\0".join(coded) + b"\0", np.uint8)
    begin = np.cumsum(sizes + 1) - sizes - 1
    reach = max(len(tables.texts[i]) for i in tables.ids)
    # A zero byte is an end only where a stretch ends.
    inside = np.ones(len(text), bool)
    inside[begin + sizes] = False
    first = np.flatnonzero(inside & ((text & 0xC0) != 0x80))
    order, keys = suffix_array(text, first, reach)
    low, high = occurrences(tables, keys)
    n = high - low
    piece = np.repeat(tables.ids, n)
    length = np.array([len(tables.texts[i]) for i in tables.ids], np.int64)
    start = order[np.repeat(low - np.cumsum(n) + n, n) + np.arange(n.sum())]
    end = start + np.repeat(length, n)
    # A character that is no piece by itself is an edge of its own, which goes with everything.
    width = 1 + (text >= 0xC0).astype(np.int64) + (text >= 0xE0) + (text >= 0xF0)
    single = np.zeros(len(text) + 1, bool)
    single[start[end - start == width[start]]] = True
    bare = first[~single[first]]
    start, end = np.concatenate([start, bare]), np.concatenate([end, bare + width[bare]])
    piece = np.concatenate([piece, np.full(len(bare), tables.unknown)])
    # Edges by how far from its stretch's start they end: all stretches are relaxed side by side.
    base = np.repeat(begin, sizes + 1)[start]
    far = end - base
    by = stable_order(far)
    start, end, piece, far, at_start = start[by], end[by], piece[by], far[by], (start == base)[by]
    token = np.full(len(text) + 1, -1, np.int64)
    origin = np.zeros(len(text) + 1, np.int64)
    cuts = np.flatnonzero(np.diff(far, prepend=-1))
    for lo, hi in zip(cuts.tolist(), np.append(cuts[1:], len(far)).tolist(), strict=True):
        before, now = token[start[lo:hi]], piece[lo:hi]
        ok = at_start[lo:hi].copy()
        some = np.flatnonzero(~ok & (before >= 0))
        ok[some] = holds(tables, before[some], now[some])
        some = np.flatnonzero(ok) + lo
        token[end[some]], origin[end[some]] = piece[some], start[some]
    # Back from each end.
    place, alive = begin + sizes, np.flatnonzero(sizes > 0)
    steps, of = [], []
    while len(alive):
        steps.append(place[alive])
        of.append(alive)
        place[alive] = origin[place[alive]]
        alive = alive[place[alive] > begin[alive]]
    if not steps:
        return np.zeros(0, np.int64), np.zeros(len(coded), np.int64)
    places, of = np.concatenate(steps[::-1]), np.concatenate(of[::-1])
    by = np.argsort(of, kind="stable")
    places, of = places[by], of[by]
    ids = token[places]
    unknown = ids == tables.unknown
    count = np.where(unknown, places - origin[places], 1)
    out = np.repeat(ids, count)
    if unknown.any():
        begins = np.repeat(origin[places] - np.cumsum(count) + count, count) + np.arange(count.sum())
        mask = np.repeat(unknown, count)
        out[mask] = tables.byte_ids[text[begins[mask]]]
    return out, np.bincount(np.repeat(of, count), minlength=len(coded))


def stretches(texts: list[str]) -> tuple[np.ndarray, list[bytes], np.ndarray]:
    """(number of each stretch of the texts, the distinct stretches, stretches of each text).

    A line end is a stretch, and so is a run of spaces with the characters up
    to the next space or line end. A text has a space in front. Spaces are `SPACE` in what is given back.
    """
    coded = [b" " + t.encode(errors="surrogatepass").replace(SPACE.encode(), b" ") if t else b"" for t in texts]
    data = b"".join(coded)
    raw = np.frombuffer(data, np.uint8)
    new = np.zeros(len(raw), bool)
    line, space = raw == 10, raw == 32
    new[1:] = line[1:] | line[:-1] | (space[1:] & ~space[:-1])
    sizes = np.array([len(c) for c in coded], np.int64)
    ends = np.cumsum(sizes)
    begins = (ends - sizes)[sizes > 0]
    new[begins] = True
    starts = np.flatnonzero(new)
    offsets = np.append(starts, len(raw)).astype(np.int64)
    found = pa.Array.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(data)]).dictionary_encode()
    distinct = [s.replace(b" ", SPACE.encode()) for s in found.dictionary.to_pylist()]
    return found.indices.to_numpy().astype(np.int64), distinct, np.diff(np.searchsorted(starts, np.append(0, ends)))


def encode_all(tables: Pieces, texts: list[str], block: int = 1 << 19) -> tuple[np.ndarray, np.ndarray]:
    """(ids of all texts in order, number of ids of each). Distinct stretches are matched in blocks of about so many bytes."""
    rows, distinct, per_text = stretches(texts)
    ids, counts, held, size = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [], 0
    for s in distinct:
        held.append(s)
        size += len(s)
        if size >= block:
            a, b = encode_stretches(tables, held)
            ids.append(a)
            counts.append(b)
            held, size = [], 0
    if held:
        a, b = encode_stretches(tables, held)
        ids.append(a)
        counts.append(b)
    ids, counts = np.concatenate(ids), np.concatenate(counts)
    n = counts[rows]
    places = np.repeat((np.cumsum(counts) - counts)[rows] - np.cumsum(n) + n, n)
    places += np.arange(len(places))
    ends = np.cumsum(per_text)
    total = np.append(0, np.cumsum(n))
    return ids.astype(np.int32)[places], total[ends] - total[ends - per_text]


def encode(tables: Pieces, texts: list[str], block: int = 1 << 19) -> list[np.ndarray]:
    """The ids of each text."""
    ids, counts = encode_all(tables, texts, block)
    return np.split(ids, np.cumsum(counts)[:-1]) if len(texts) else []


def decode(tables: Pieces, ids: list[int]) -> str:
    """The text of ids, without the leading space that encoding adds; bytes that are no UTF-8 become U+FFFD."""
    text = b"".join([tables.decoded[i] for i in ids]).decode(errors="replace")
    return text[1:] if text.startswith(" ") else text


def encoded(docs: DataFrame, model: str, text: str = "text", check: bool = True) -> DataFrame:
    """All columns of `docs` but the text, and a last column `encoding` of `ids` and, with `check`, `decoded`.

    `model` is the path of the model file on the driver; its tables travel to
    the tasks. Null and empty texts have no ids. Whole texts are encoded, some
    megabytes of them at a time; repeated rows each keep their row. Where `docs` has a column `encoding` the new
    one gets underscores in front. An empty table gives no rows.
    """
    tables = load(model)
    kept = [c for c in docs.columns if c != text]
    name = fresh(docs, "encoding")
    kind = "struct<ids:array<int>,decoded:string>" if check else "struct<ids:array<int>>"
    body = fresh(docs, "_text")
    rows = docs.select(*kept, F.coalesce(F.col(text), F.lit("")).alias(body))
    result = docs.select(*kept, F.lit(None).cast(kind).alias(name)).schema

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, column = 0, batch.column(len(kept))
            while at < batch.num_rows:
                begin, texts, size = at, [], 0
                while at < batch.num_rows and (not texts or size < TEXTS):
                    texts.append(column[at].as_py())
                    size += len(texts[-1])
                    at += 1
                ids, counts = encode_all(tables, texts)
                offsets = np.append(0, np.cumsum(counts))
                lists = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(ids))
                fields = {"ids": lists}
                if check:
                    fields["decoded"] = pa.array([decode(tables, ids[a:b].tolist()) for a, b in zip(offsets[:-1], offsets[1:], strict=True)], pa.string())
                struct = pa.StructArray.from_arrays(list(fields.values()), list(fields))
                columns = [batch.column(i).slice(begin, at - begin) for i in range(len(kept))]
                yield pa.RecordBatch.from_arrays([*columns, struct], result.names)

    return rows.mapInArrow(run, result)
