"""Phrase collocations by prefix-free parsing.

The words of a text are cut where the hash of a few words in a row says so, so
shared passages give the same chunks wherever they stand. A chunk runs on over
the words that open the next one, and a phrase belongs to the chunk in which it
starts before these: each occurrence is in one chunk. Distinct chunks form a
dictionary with the number of times each was parsed, and phrases are counted
once per distinct chunk, by that weight.

Most phrases are rare, and are never sent as text. Blocks of the dictionary
exchange packed numbers for all phrases but the longest, get back one bit for
each that may reach the least count, and send the text of these alone, and of
longest phrases whose two halves got the bit.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from newsloom.llm.lexing import Words, byte_classes, utf8
from newsloom.llm.runs import mixed
from newsloom.llm.sorted_runs import pack, unpack
from newsloom.session import written

BLANKS, BREAKS = b" \t", b".,;:!?\n\x0b\x0c\r"
CLASSES = byte_classes(BLANKS, BREAKS)
#: Mean words between two cuts, and bytes of text that a task looks at at once.
APART, TEXTS = 16, 4 << 20
#: Bytes of distinct chunks in a block, and bytes of all texts for each part of the exchange.
BLOCK, PART = 8 << 20, 16 << 20
#: Bits of a phrase's hash in the exchange; equal ones are candidates, no more.
BITS = 48

#: A chunk, the number of its last words that open the next one, and how often it was parsed.
CHUNKS = "lang string, chunk binary, overlap int"


def word_hashes(distinct: list[bytes]) -> np.ndarray:
    digest = xxhash.xxh3_64_intdigest
    return np.array([digest(w) for w in distinct], np.uint64)


def run_hashes(h: np.ndarray, n: int, seed: np.ndarray | int = 0) -> np.ndarray:
    """A hash of the first word's run of `n` words, for each word with `n` words from it on."""
    size = max(0, len(h) - n + 1)
    out = np.full(size, n, np.uint64) + seed
    for k in range(n):
        out = mixed(out * np.uint64(0x9E3779B97F4A7C15) + h[k : size + k])
    return out


def in_piece(joined: np.ndarray, n: int) -> np.ndarray:
    """Whether the `n` words from each word on are in one piece, for each word with `n` words from it on."""
    size = max(0, len(joined) - n + 1)
    out = np.ones(size, bool)
    for k in range(n - 1):
        out &= joined[k : size + k]
    return out


def chunks(docs: DataFrame, text: str, lang: str, longest: int) -> DataFrame:
    """`CHUNKS` and `n`: the distinct chunks of all texts with their frequencies."""
    overlap = longest - 1

    def cut(langs: pa.Array, texts: list[bytes]) -> pa.RecordBatch:
        words = Words(texts, CLASSES)
        codes, distinct = words.encoded()
        opens = np.zeros(len(words), bool)
        if overlap and len(words):
            h = word_hashes(distinct.to_pylist())[codes]
            runs = run_hashes(h, overlap)
            opens[: len(runs)] = (runs % np.uint64(APART) == 0) & in_piece(words.joined, overlap)
        new = np.diff(words.text, prepend=-1) != 0
        first = np.flatnonzero(opens | new)
        following = np.append(first[1:], len(words))
        shared = np.zeros(len(first), np.int32)
        # A chunk that the next text follows runs on over nothing.
        shared[:-1][~new[first[1:]]] = overlap
        begin = words.start[first]
        end = words.end[following - 1 + shared] if len(first) else begin
        data = words.data
        found = [data[a:b] for a, b in zip(begin.tolist(), end.tolist(), strict=True)]
        return pa.RecordBatch.from_arrays([langs.take(pa.array(words.text[first])), pa.array(found, pa.binary()), pa.array(shared)], ["lang", "chunk", "overlap"])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values, at = utf8(batch.column(1)), 0
            while at < len(values):
                begin, size = at, 0
                while at < len(values) and size < TEXTS:
                    size += len(values[at])
                    at += 1
                yield cut(batch.column(0).slice(begin, at - begin), values[begin:at])

    rows = docs.select(F.coalesce(F.col(lang).cast("string"), F.lit("und")).alias("lang"), F.col(text).alias("text"))
    return rows.mapInArrow(run, CHUNKS).groupBy("lang", "chunk", "overlap").agg(F.count("*").alias("n"))


class Block:
    """Distinct chunks with their weights, and the distinct phrases in them."""

    def __init__(self, langs: list[str], chunks: list[bytes], overlap: np.ndarray, n: np.ndarray):
        # Lower case is there already.
        self.words = Words(chunks, CLASSES, lower=False)
        self.langs = sorted(set(langs))
        number = {x: i for i, x in enumerate(self.langs)}
        self.lang = np.array([number[x] for x in langs], np.int64)[self.words.text]
        codes, distinct = self.words.encoded()
        size = np.bincount(self.words.text, minlength=len(chunks))
        place = np.arange(len(codes)) - (np.cumsum(size) - size)[self.words.text]
        starts = place < (size - overlap)[self.words.text]
        self.weight = np.where(starts, n[self.words.text], 0)
        # A word of each language has a code of its own, so codes tell the language too.
        self.kinds, self.codes = np.unique(self.lang * len(distinct) + codes, return_inverse=True)
        hashes = word_hashes(distinct.to_pylist())
        seeds = word_hashes([x.encode(errors="surrogatepass") for x in self.langs])
        of_kind = mixed(hashes[self.kinds % len(distinct)] + seeds[self.kinds // len(distinct)]) if len(distinct) else hashes
        self.hashes = of_kind[self.codes]

    def totals(self) -> dict[str, int]:
        """Occurrences of all words by language."""
        return {x: int(self.weight[self.lang == i].sum()) for i, x in enumerate(self.langs)}

    def phrases(self, n: int, chosen: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of phrases of `n` words: the number of each place's phrase (-1: none), a place of each phrase, its weight.

        Only the chosen places count, where given.
        """
        valid = in_piece(self.words.joined, n)
        if chosen is not None:
            valid &= chosen[: len(valid)]
        places = np.flatnonzero(valid)
        found = self.codes[places]
        for k in range(1, n):
            # Both numbers are below the number of places, so the pair fits a long, exactly.
            found = np.unique(found * len(self.kinds) + self.codes[places + k], return_inverse=True)[1]
        count = int(found.max()) + 1 if len(found) else 0
        number = np.full(len(self.codes), -1, np.int64)
        number[places] = found
        first = np.zeros(count, np.int64)
        first[found[::-1]] = places[::-1]
        weight = np.zeros(count, np.int64)
        np.add.at(weight, found, self.weight[places])
        return number, first, weight

    def text(self, first: np.ndarray, n: int) -> list[bytes]:
        words = self.words
        data = words.data
        parts = [[data[a:b] for a, b in zip(words.start[first + k].tolist(), words.end[first + k].tolist(), strict=True)] for k in range(n)]
        return [b" ".join(p) for p in zip(*parts, strict=True)] if n > 1 else parts[0]

    def hashed(self, first: np.ndarray, n: int) -> np.ndarray:
        out = np.full(len(first), n, np.uint64)
        for k in range(n):
            out = mixed(out * np.uint64(0x9E3779B97F4A7C15) + self.hashes[first + k])
        return (out >> np.uint64(64 - BITS)).astype(np.int64)


#: Rows of the exchange: of a part, a block's sorted hashes and weights; of no part, the block's chunks.
SENT = "block long, part int, hashes binary, weights binary, chunks binary, langs array<string>"


def blocks(rows: DataFrame, longest: int, parts: int) -> DataFrame:
    """`SENT`: the dictionary in blocks, with what each has to exchange."""
    kinds = pa.schema([("block", pa.int64()), ("part", pa.int32()), ("hashes", pa.binary()), ("weights", pa.binary()), ("chunks", pa.binary()), ("langs", pa.list_(pa.string()))])

    def rows_of(number: int, held: list[tuple]) -> Iterator[pa.RecordBatch]:
        langs, found, overlap, n = ([x for part in held for x in part[i]] for i in range(4))
        block = Block(langs, found, np.array(overlap), np.array(n))
        index = {x: i for i, x in enumerate(block.langs)}
        # The chunks stay without their texts' ends: the lengths tell these.
        heads = [pack(np.array(x, np.int64)) for x in ([len(c) for c in found], overlap, n, [index[x] for x in langs])]
        body = b"".join(found)
        sizes = np.array([*map(len, heads), len(body)], "<u8").tobytes()
        packed = sizes + b"".join(heads) + pa.compress(body, codec="zstd", asbytes=True)
        yield pa.RecordBatch.from_pylist([{"block": number, "part": -1, "chunks": packed, "langs": block.langs}], kinds)
        h, weight = exchanged(block, longest)
        cuts = np.searchsorted(h, np.array([(p << BITS) // parts for p in range(parts + 1)]))
        sent = [
            {"block": number, "part": p, "hashes": pack(np.diff(h[a:b], prepend=0)), "weights": pack(weight[a:b])}
            for p, (a, b) in enumerate(zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True))
            if a < b
        ]
        if sent:
            yield pa.RecordBatch.from_pylist(sent, kinds)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, held, size = TaskContext.get().partitionId() << 32, [], 0
        for batch in batches:
            columns, at = [c.to_pylist() for c in batch.columns], 0
            for i, chunk in enumerate(columns[1]):
                size += len(chunk) + 1
                if size >= BLOCK:
                    yield from rows_of(number, [*held, tuple(c[at : i + 1] for c in columns)])
                    number, held, size, at = number + 1, [], 0, i + 1
            if at < batch.num_rows:
                held.append(tuple(c[at:] for c in columns))
        if held:
            yield from rows_of(number, held)

    return written(rows.mapInArrow(run, SENT), "phrases-blocks")


def exchanged(block: Block, longest: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted hashes and weights of a block's distinct phrases of fewer words than the longest."""
    found = [(block.hashed(first, n), weight) for n in range(1, longest) for _, first, weight in [block.phrases(n)]]
    h, weight = (np.concatenate(x) for x in zip(*found, strict=True))
    order = np.argsort(h, kind="stable")
    return h[order], weight[order]


def replies(sent: DataFrame, least: int, parts: int) -> DataFrame:
    """(`block`, `part`, `size`, `flags`): a bit for each number of the block, in order, set if its weights over all blocks reach the least."""

    def answered(part: int, held: list[tuple]) -> Iterator[pa.RecordBatch]:
        h = np.concatenate([x[1] for x in held])
        size = [len(x[1]) for x in held]
        order = np.argsort(h, kind="stable")
        begin = np.flatnonzero(np.diff(h[order], prepend=-1))
        enough = np.add.reduceat(np.concatenate([x[2] for x in held])[order], begin) >= least
        flags = np.empty(len(h), bool)
        flags[order] = np.repeat(enough, np.diff(np.append(begin, len(h))))
        out = [np.packbits(f).tobytes() for f in np.split(flags, np.cumsum(size)[:-1])]
        columns = pa.array([x[0] for x in held], pa.int64()), pa.array([part] * len(out), pa.int32()), pa.array(size, pa.int64()), pa.array(out, pa.binary())
        yield pa.RecordBatch.from_arrays(list(columns), ["block", "part", "size", "flags"])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, held = None, []
        for batch in batches:
            for block, p, hashes, weights in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if p != part and held:
                    yield from answered(part, held)
                    held = []
                part = p
                held.append((block, np.cumsum(unpack(hashes)), unpack(weights)))
        if held:
            yield from answered(part, held)

    rows = sent.filter("part >= 0").select("block", "part", "hashes", "weights")
    dealt = rows.repartitionById(parts, F.col("part")).sortWithinPartitions("part")
    return dealt.mapInArrow(run, "block long, part int, size long, flags binary")


def unpacked_chunks(data: bytes, names: list[str]) -> tuple[list[str], list[bytes], np.ndarray, np.ndarray]:
    sizes = np.frombuffer(data[:40], "<u8").astype(np.int64)
    ends = 40 + np.cumsum(sizes[:4])
    lengths, overlap, n, lang = (unpack(data[b - s : b]) for s, b in zip(sizes[:4].tolist(), ends.tolist(), strict=True))
    body = pa.decompress(data[ends[-1] :], int(sizes[4]), codec="zstd", asbytes=True) if sizes[4] else b""
    stops = np.cumsum(lengths)
    found = [body[a:b] for a, b in zip((stops - lengths).tolist(), stops.tolist(), strict=True)]
    return [names[i] for i in lang.tolist()], found, overlap, n


def counted(sent: DataFrame, flags: DataFrame, longest: int, least: int) -> DataFrame:
    """(`lang`, `phrase`, `words`, `n`): all phrases with the least count or more, and as empty phrase the words of each language."""
    kinds = pa.schema([("lang", pa.string()), ("phrase", pa.string()), ("words", pa.int32()), ("n", pa.int64())])

    def survivors(block: Block, flags: np.ndarray) -> Iterator[pa.RecordBatch]:
        totals = block.totals()
        yield pa.RecordBatch.from_pylist([{"lang": x, "phrase": "", "words": 0, "n": n} for x, n in totals.items()], kinds)
        langs = pa.array(block.langs)
        tables = [block.phrases(n) for n in range(1, longest)]
        h = np.concatenate([block.hashed(first, n) for n, (_, first, _) in enumerate(tables, 1)])
        enough = np.empty(len(h), bool)
        enough[np.argsort(h, kind="stable")] = flags[: len(h)]
        at = 0
        for n in range(1, longest + 1):
            if n < longest:
                number, first, weight = tables[n - 1]
                alive = enough[at : at + len(first)]
                at += len(first)
                frequent = np.append(alive, False)[number]
            else:
                # Both halves of a longest phrase must be able to reach the count.
                halves = frequent.copy()
                halves[:-1] &= frequent[1:]
                _, first, weight = block.phrases(n, halves)
                alive = np.ones(len(first), bool)
            alive = alive & (weight > 0)
            first, weight = first[alive], weight[alive]
            for a in range(0, len(first), 50_000):
                part = first[a : a + 50_000]
                texts = pa.array(block.text(part, n), pa.binary()).view(pa.string())
                lang = langs.take(pa.array(block.lang[part]))
                yield pa.RecordBatch.from_arrays([lang, texts, pa.array([n] * len(part), pa.int32()), pa.array(weight[a : a + 50_000])], schema=kinds)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, chunks, flags = None, None, []

        def evaluated() -> Iterator[pa.RecordBatch]:
            block = Block(*unpacked_chunks(*chunks))
            bits = [np.unpackbits(np.frombuffer(f, np.uint8), count=n).astype(bool) for f, n in flags]
            yield from survivors(block, np.concatenate([*bits, np.zeros(0, bool)]))

        for batch in batches:
            for number, _, packed, names, size, bits in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if packed is not None:
                    if chunks:
                        yield from evaluated()
                    current, chunks, flags = number, (packed, names), []
                elif number == current:
                    flags.append((bits, size))
        if chunks:
            yield from evaluated()

    texts = sent.filter("part = -1").select("block", "part", "chunks", "langs", F.lit(None).cast("long").alias("size"), F.lit(None).cast("binary").alias("flags"))
    bits = flags.select("block", "part", F.lit(None).cast("binary").alias("chunks"), F.lit(None).cast("array<string>").alias("langs"), "size", "flags")
    parts = int(sent.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # The few blocks of one task go to different ones.
    place = F.pmod(F.shiftright("block", 32) * 7 + F.col("block").bitwiseAND(F.lit((1 << 32) - 1)), F.lit(parts)).cast("int")
    rows = texts.unionByName(bits).repartitionById(parts, place).sortWithinPartitions("block", "part")
    found = rows.mapInArrow(run, "lang string, phrase string, words int, n long")
    found = found.groupBy("lang", "phrase", "words").agg(F.sum("n").alias("n"))
    return written(found.filter((F.col("words") == 0) | (F.col("n") >= least)), "phrases-counted")


def phrase_counts(docs: DataFrame, text: str = "text", lang: str = "lang", longest: int = 3, least: int = 10) -> DataFrame:
    """(`lang`, `phrase`, `words`, `n`): how often each phrase of 1 to `longest` words occurs within pieces, if `least` times or more.

    The empty phrase has the number of all words of its language.
    """
    if longest < 2 or least < 1:
        raise ValueError("phrases have two words or more, and the least count is 1 or more")
    spark = docs.sparkSession
    size = docs.agg(F.sum(F.length(text))).first()[0] or 0
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // PART))
    sent = blocks(chunks(docs, text, lang, longest), longest, parts)
    return counted(sent, replies(sent, least, parts), longest, least)


def collocations(
    docs: DataFrame, text: str = "text", lang: str = "lang", longest: int = 3, least: int = 10, percent: int = 50, top: int = 2000
) -> DataFrame:
    """(`lang`, `rank`, `phrase`, `a`, `l`, `r`, `n`, `score`): the first `top` phrases of each language by score.

    Texts are A-Z lower-cased and cut at `.,;:!?` and line ends into pieces,
    these at blanks and tabs into words. A phrase of 2 to `longest` words that
    occurs `a` >= `least` times, overlaps included, is a candidate; cut after
    its first words, `l` and `r` are how often its parts occur, and the score
    is floor(10**6 a a / (l r)), that of the lowest-scoring cut, the earliest
    of ties. A candidate goes if a longer one that contains it occurs at least
    `percent` percent as often. Ties are ranked by `a`, falling, then phrase.
    A null language is `und`, and one with it; null and empty texts have no
    words; repeated rows count each; an empty table gives no rows; other
    columns are not read. Counts are whole numbers throughout, and a score is
    exact for counts up to 10**15.
    """
    counts = phrase_counts(docs, text, lang, longest, least)
    words = F.split("phrase", " ")
    phrases = counts.filter("words >= 2").select("lang", "phrase", "words", F.col("n").alias("a"))
    part = lambda first, size: F.array_join(F.slice(words, first, size), " ")
    # What a candidate's longer neighbours say: the most frequent one that contains it.
    inside = phrases.filter("words > 2").select(
        "lang",
        "a",
        F.explode(
            F.flatten(
                F.transform(
                    F.sequence(F.lit(2), F.col("words") - 1),
                    lambda size: F.transform(F.sequence(F.lit(1), F.col("words") - size + 1), lambda at: F.array_join(F.slice(words, at, size), " ")),
                )
            )
        ).alias("phrase"),
    )
    longer = inside.groupBy(F.col("lang").alias("_lang"), F.col("phrase").alias("_phrase")).agg(F.max("a").alias("_longer"))
    kept = phrases.join(longer, (F.col("lang") == F.col("_lang")) & (F.col("phrase") == F.col("_phrase")), "left")
    kept = kept.filter(F.col("_longer").isNull() | (100 * F.col("_longer") < percent * F.col("a"))).drop("_lang", "_phrase", "_longer")
    cuts = kept.select("*", F.explode(F.sequence(F.lit(1), F.col("words") - 1)).alias("k"))
    cuts = cuts.select("*", part(F.lit(1), F.col("k")).alias("left"), part(F.col("k") + 1, F.col("words") - F.col("k")).alias("right"))
    for side, name in (("left", "l"), ("right", "r")):
        other = counts.select(F.col("lang").alias("_lang"), F.col("phrase").alias("_phrase"), F.col("n").alias(name))
        cuts = cuts.join(other, (F.col("lang") == F.col("_lang")) & (F.col(side) == F.col("_phrase"))).drop("_lang", "_phrase", side)
    cuts = cuts.withColumn("score", exact_score("a", "l", "r"))
    best = cuts.groupBy("lang", "phrase", "a").agg(F.min(F.struct("score", "k", "l", "r")).alias("cut"))
    rows = best.select("lang", "phrase", "a", "cut.l", "cut.r", "cut.score")
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase"))
    ranked = rows.withColumn("rank", rank).filter(F.col("rank") <= top)
    totals = counts.filter("words = 0").select(F.col("lang").alias("_lang"), F.col("n"))
    ranked = ranked.join(totals, F.col("lang") == F.col("_lang"))
    return ranked.select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")


def exact_score(a: str, l: str, r: str) -> Column:  # noqa: E741
    """floor(10**6 a a / (l r)) in whole numbers of 38 digits."""
    wide = lambda c: F.col(c).cast("decimal(16,0)")
    million = F.lit(1_000_000).cast("decimal(7,0)")
    top, bottom = (million * (wide(a) * wide(a))).cast("decimal(38,0)"), (wide(l) * wide(r)).cast("decimal(38,0)")
    return F.call_function("div", top, bottom)
