"""The registered queries of this subpackage, each over a whole table."""

from __future__ import annotations

from pyspark.sql import functions as F

from newsloom.llm import (
    fingerprints,
    mixing,
    phrases,
    pieces,
    postings,
    quality,
    simhash,
    substrings,
    suffixes,
    token_counts,
    toxicity,
    warc,
    whitening,
)
from newsloom.session import scratch_path
from newsloom.sources.tables import read_table

QUERIES: dict = {}


def query(function):
    QUERIES[function.__name__] = function
    return function


@query
def op5_mix_sources(spark, sf):
    plan = mixing.mix(read_table(spark, sf, "documents"), plan_only=True)
    taken = (F.col("size") * F.col("copies")).alias("taken")
    return plan.select("doc_id", "size", "source_size", "target", taken, "copies", "source")


def tokenizer_path(name: str) -> str:
    """The file of a public tokenizer; on a cluster it is installed on every machine."""
    import public_tokenizers

    return str(public_tokenizers.path(name))


@query
def op7_token_counts(spark, sf):
    """The cache starts empty here, so every distinct text is encoded."""
    cache = scratch_path(spark, "token-cache")
    docs = read_table(spark, sf, "documents").select("doc_id", "text")
    counts = token_counts.token_counts(docs, cache, tokenizer_path("piece_bpe_32k.model"))
    return counts.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > 4096).alias("over_limit"))


@query
def op9_warc(spark, sf):
    folder = warc.archive_folder(spark)
    archives = warc.write_archives(read_table(spark, sf, "pages"), folder)
    return warc.read_archives(spark, archives, folder).select(
        "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"
    )


@query
def op10_quality_rules(spark, sf):
    docs = read_table(spark, sf, "documents").select("doc_id", "text")
    rows = quality.judged(docs, read_table(spark, sf, "labels"))
    counts = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    shown = [f"judgement.statistics.{c}" for c in counts]
    return rows.select("doc_id", *shown, "judgement.base_failed", "judgement.kept", "judgement.rule")


@query
def op3_fingerprints(spark, sf):
    return fingerprints.fingerprints(read_table(spark, sf, "documents"))


@query
def op6_toxicity(spark, sf):
    return toxicity.toxicity(read_table(spark, sf, "documents"), read_table(spark, sf, "labels"))


@query
def op1_simhash_dedup(spark, sf):
    rows = simhash.near_duplicates(read_table(spark, sf, "documents"))
    return rows.select("doc_id", simhash.as_hex(F.col("print")).alias("fingerprint"), "component_id")


@query
def op4_substring_dedup(spark, sf):
    docs = read_table(spark, sf, "documents").select("doc_id", "text")
    kept = F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256")
    return substrings.remove_repeats(docs).select("doc_id", "removal.n_words", "removal.n_removed", kept)


@query
def op8_sentencepiece(spark, sf):
    docs = read_table(spark, sf, "documents").select("doc_id", "text")
    rows = pieces.encoded(docs, tokenizer_path("piece_bpe_32k.model"))
    n = F.size("encoding.ids").cast("long").alias("n_tokens")
    return rows.select("doc_id", n, "encoding.ids", F.sha2("encoding.decoded", 256).alias("decoded_sha256"))


@query
def op2_suffix_dedup(spark, sf):
    docs = read_table(spark, sf, "documents").select("doc_id", "text")
    shown = [f"removal.{c}" for c in ("n_bytes", "n_removed", "n_spans", "kept_sha256")]
    return suffixes.remove_repeats(docs).select("doc_id", *shown)


@query
def op13_embedding_whitening(spark, sf):
    """A deviation beyond a long is null here; the operator has it as decimal."""
    rows = whitening.whitened(read_table(spark, sf, "embeddings").select("vec_id", "embedding"))
    w = F.col("whitening")
    rows = rows.select("vec_id", w.n.alias("n"), w.deviation.try_cast("long").alias("deviation"), w.identity_error.alias("identity_error"), F.explode(w.components).alias("c"))
    return rows.select("vec_id", "c.component", "n", "deviation", "c.whitened", "c.explained", "identity_error")


@query
def op12_benchmark_decontamination(spark, sf):
    rows = postings.benchmark_hits(read_table(spark, sf, "documents"), read_table(spark, sf, "benchmark"))
    size = lambda c: F.size(f"hits.{c}").cast("long")
    return rows.select(
        "doc_id",
        "hits.n_words",
        "hits.n_hit",
        size("items").alias("n_items"),
        F.sha2(F.array_join("hits.items", ","), 256).alias("items_sha256"),
        (F.col("hits.n_hit") > 0).alias("contaminated"),
        size("near_items").alias("n_near_items"),
    )


@query
def op11_phrase_collocations(spark, sf):
    return phrases.collocations(read_table(spark, sf, "documents"))
