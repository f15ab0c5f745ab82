"""Token counts from a digest cache.

The cache is a Parquet table of (content_digest, tokenizer_digest, n_tokens).
Texts are looked up by digest, only distinct misses are encoded, and what they
give is appended for later runs.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from newsloom.llm.words import fresh
from newsloom.session import written

CACHE = "content_digest binary, tokenizer_digest string, n_tokens long"


def encoder(path: str) -> Callable[[list[str]], list[int]]:
    """Counts by the library for the file: sentencepiece for `.model`, tokenizers for `.json`.

    No begin, end or added special tokens, no truncation, no padding; special
    strings inside a text are handled as the library does by default.
    """
    if path.endswith(".model"):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        return lambda texts: [len(x) for x in model.encode(texts, num_threads=1)]
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    tokenizer.no_truncation()
    tokenizer.no_padding()
    return lambda texts: [len(x.ids) for x in tokenizer.encode_batch(texts, add_special_tokens=False)]


def tokenizer_digest(path: str) -> str:
    """What names a tokenizer version in the cache: the library, its version and the file's bytes."""
    import sentencepiece
    import tokenizers

    library = sentencepiece if path.endswith(".model") else tokenizers
    with open(path, "rb") as file:
        content = file.read()
    return hashlib.sha256(f"{library.__name__} {library.__version__} ".encode() + content).hexdigest()


def normalised(text: Column) -> Column:
    """The content a count belongs to: the text itself, null as empty.

    Any stronger folding would give one count to texts that encode differently.
    """
    return F.coalesce(text, F.lit(""))


def content_digest(text: Column) -> Column:
    return F.unhex(F.sha2(normalised(text), 256))


def read_cache(spark: SparkSession, cache: str) -> DataFrame:
    """The stored counts; none where nothing has been stored yet."""
    try:
        return spark.read.schema(CACHE).parquet(cache)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], CACHE)


def stored_counts(docs: DataFrame, cache: str, version: str, text: str = "text") -> DataFrame:
    """The entries of the cache for the texts of `docs` and this tokenizer, one for each digest.

    The cache is read once and met with the digests of the documents, so that
    only what they need is shuffled on, grouped and kept.
    """
    needed = docs.select(content_digest(F.col(text)).alias("content_digest")).distinct()
    stored = read_cache(docs.sparkSession, cache).filter(F.col("tokenizer_digest") == version)
    found = stored.join(needed, "content_digest", "left_semi").groupBy("content_digest").agg(F.max("n_tokens").alias("n_tokens"))
    return written(found, "stored-counts")


def encode_misses(docs: DataFrame, stored: DataFrame, cache: str, model: str, text: str = "text", batch_chars: int = 1 << 20) -> DataFrame:
    """The counts of distinct texts that `stored` lacks, appended to the cache too.

    Equal texts meet once: each task keeps one text per digest before the
    shuffle, so a text that a third of all rows share is one row per task. The
    stored digests join on the same key, with no second shuffle of texts. Texts
    are then encoded in calls of about `batch_chars` characters.
    """
    version = tokenizer_digest(model)
    rows = docs.select(content_digest(F.col(text)).alias("content_digest"), normalised(F.col(text)).alias("text"))
    misses = rows.groupBy("content_digest").agg(F.any_value("text").alias("text"))
    misses = misses.join(stored.select("content_digest"), "content_digest", "left_anti")

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = encoder(model)
        for batch in batches:
            found: list[int] = []
            held: list[str] = []
            n_chars = 0
            for value in batch.column("text"):
                held.append(value.as_py())
                n_chars += len(held[-1])
                if n_chars >= batch_chars:
                    found += counts(held)
                    held, n_chars = [], 0
            found += counts(held)
            n = len(found)
            yield pa.RecordBatch.from_arrays(
                [batch.column("content_digest"), pa.array([version] * n, pa.string()), pa.array(found, pa.int64())],
                ["content_digest", "tokenizer_digest", "n_tokens"],
            )

    new = written(misses.select("content_digest", "text").mapInArrow(count, CACHE), "new-counts")
    new.write.mode("append").parquet(cache)
    return new.select("content_digest", "n_tokens")


def token_counts(docs: DataFrame, cache: str, model: str, text: str = "text") -> DataFrame:
    """All columns of `docs` but the text, with `n_bytes` (UTF-8) and `n_tokens`.

    Counts are those stored for the texts of `docs` and, appended to the cache,
    those of the misses; other entries of the cache are not carried along. Null
    texts count as empty, repeated rows each keep their row, an empty table
    gives no rows. Two runs at a time may store a count twice: equal
    entries are reduced as the cache is read. Columns named like those of the
    cache are kept as they are.
    """
    stored = stored_counts(docs, cache, tokenizer_digest(model), text)
    counts = stored.unionByName(encode_misses(docs, stored, cache, model, text))
    digest, key, n = (fresh(docs, x) for x in ("_digest", "_key", "_n_tokens"))
    counts = counts.select(F.col("content_digest").alias(key), F.col("n_tokens").alias(n))
    kept = [c for c in docs.columns if c != text and c not in ("n_bytes", "n_tokens")]
    rows = docs.select(
        *kept, F.octet_length(normalised(F.col(text))).cast("long").alias("n_bytes"), content_digest(F.col(text)).alias(digest)
    )
    return rows.join(counts, rows[digest] == counts[key]).select(*kept, "n_bytes", F.col(n).alias("n_tokens"))
