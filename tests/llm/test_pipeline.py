"""The registered queries against their SQL, and the pipeline against brute force stage by stage."""

import hashlib
import re

import pytest
import sentencepiece

import corpus_pipeline
from newsloom.llm import simhash
from newsloom.llm.oracles import ORACLES
from newsloom.llm.queries import QUERIES, tokenizer_path
from tests.llm.test_mixing_tokens import targets
from tests.llm.test_repeats import slow, words_of
from tests.llm.test_simhash import slow_classes
from tools.check_queries import connect, rows_of

FOLDER = "/root/testdata/sf0.001"


def test_one_query_per_operator():
    assert sorted(int(re.match(r"op(\d+)_", n)[1]) for n in QUERIES) == list(range(1, 14))
    assert set(ORACLES) <= set(QUERIES)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, name):
    got = QUERIES[name](spark, FOLDER).toArrow()
    want = connect(FOLDER).sql(ORACLES[name]).to_arrow_table()
    assert sorted(got.column_names) == sorted(want.column_names)
    assert rows_of(got) == rows_of(want)


def test_query_columns(spark):
    wanted = {
        "op1": "doc_id fingerprint component_id",
        "op3": "doc_id n_chars edited_sha256 fingerprint edited_fingerprint near_edited near_next",
        "op6": "doc_id held_out score predicted",
        "op7": "doc_id n_bytes n_tokens over_limit",
        "op12": "doc_id n_words n_hit n_items items_sha256 contaminated",
        "op10": "doc_id n_words word_chars n_symbols n_dup_lines n_repeat_words base_failed kept",
    }
    for start, columns in wanted.items():
        name = next(n for n in QUERIES if n.startswith(f"{start}_"))
        frame = QUERIES[name](spark, FOLDER)
        assert set(columns.split()) <= set(frame.columns), name
        assert frame.count() == spark.read.parquet(f"{FOLDER}/documents.parquet").count(), name


def test_pipeline_stage_by_stage(spark):
    stages = dict(corpus_pipeline.STAGES)
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    columns = docs.columns
    kept = stages["quality_rules"](spark, docs, FOLDER)
    verdict = {r["doc_id"]: r["kept"] for r in QUERIES["op10_quality_rules"](spark, FOLDER).collect()}
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted(k for k, v in verdict.items() if v)

    rows = [(r["doc_id"], r["text"]) for r in kept.collect()]
    single = stages["near_duplicates"](spark, kept, FOLDER)
    assert {r["doc_id"] for r in single.collect()} == {c for _, _, c in slow_classes(rows)}

    rows = sorted((r["doc_id"], r["text"]) for r in single.collect())
    clean = stages["repeated_passages"](spark, single, FOLDER)
    got = {r["doc_id"]: r for r in clean.collect()}
    assert clean.columns == columns and len(got) == len(rows)
    for (k, t), mask in zip(rows, slow(rows, words_of, 50), strict=True):
        text = b" ".join(w for w, m in zip(words_of(t), mask, strict=True) if not m).decode()
        assert got[k]["text"] == text and got[k]["n_chars"] == len(text)

    sizes = {}
    for r in got.values():
        sizes[r["source"]] = sizes.get(r["source"], 0) + len(words_of(r["text"]))
    want, counts = targets(sizes), {}
    mixed = stages["source_mix"](spark, clean, FOLDER)
    assert mixed.columns == columns
    for r in mixed.collect():
        counts[r["doc_id"]] = counts.get(r["doc_id"], 0) + 1
    for k, r in got.items():
        rate = want[r["source"]] / sizes[r["source"]] if sizes[r["source"]] else 0
        draw = int(hashlib.md5(f"20:{k}".encode()).hexdigest()[:13], 16) / 2**52
        assert counts.get(k, 0) == int(rate) + (draw < rate % 1)

    model = sentencepiece.SentencePieceProcessor(model_file=tokenizer_path("piece_bpe_32k.model"))
    last = stages["encode"](spark, mixed, FOLDER).collect()
    assert sorted((r["doc_id"], r["ids"]) for r in last) == sorted((k, model.encode(got[k]["text"])) for k, n in counts.items() for _ in range(n))
    whole = corpus_pipeline.run(spark, FOLDER).collect()
    assert sorted((r["doc_id"], r["ids"]) for r in whole) == sorted((r["doc_id"], r["ids"]) for r in last)


def test_pipeline_decodes(spark, docs):
    """The last stage gives a digest of what the library decodes the ids to, which is not always the text."""
    texts = ["\u2581x", " two  blanks ", "a\n\tb \U0001f600 \u0000", "", None]
    model = sentencepiece.SentencePieceProcessor(model_file=tokenizer_path("piece_bpe_32k.model"))
    rows = corpus_pipeline.encode(spark, docs(list(enumerate(texts))), FOLDER).collect()
    got = {r["doc_id"]: (r["ids"], r["decoded_sha256"]) for r in rows}
    ids = [model.encode(t or "") for t in texts]
    assert got == {k: (x, hashlib.sha256(model.decode(x).encode()).hexdigest()) for k, x in enumerate(ids)}
    assert model.decode(ids[0]) != texts[0]


def test_fingerprint_text(spark):
    frame = spark.createDataFrame([(-1,), (0,), (255,)], "v long")
    assert [r[0] for r in frame.select(simhash.as_hex(frame["v"])).collect()] == ["f" * 16, "0" * 16, "0" * 14 + "ff"]


def odd_table(spark):
    """Nulls, empty and very long texts, repeated rows, and columns named like those that operators add."""
    import numpy as np

    rng = np.random.default_rng(14)
    prose = lambda n: " ".join(f"w{x}" for x in rng.integers(0, 60_000, n))
    one, passage, long = prose(120), prose(70), prose(150_000)
    texts = [
        (5000, one), (5000, one), (5001, one), (None, prose(100)), (None, prose(100)), (5002, None), (5003, ""), (5004, " \n\t"),
        (5005, f"{prose(60)} {passage} {prose(50)}"), (5006, f"{prose(55)} {passage} {prose(65)}"), (5007, long), (5008, "few words"), (None, None),
    ]
    rows = [(k, t, None if i % 3 else "en", None if i % 4 == 3 else "s", len(t or ""), i, "x", [i], i, "c", "t") for i, (k, t) in enumerate(texts)]
    kind = "doc_id long, text string, lang string, source string, n_chars long, judgement int, removal string, encoding array<int>, _doc int, _content string, _text string"
    return spark.createDataFrame(rows, kind), texts, passage


def test_pipeline_of_odd_rows(spark):
    docs, texts, passage = odd_table(spark)
    stages = dict(corpus_pipeline.STAGES)
    kept = stages["quality_rules"](spark, docs, FOLDER)
    assert kept.columns == docs.columns
    # Base test: ten words or more. Nothing else is known of these ids.
    want = sorted((str(k), t) for k, t in texts if t and len(t.split()) >= 10)
    assert sorted((str(r["doc_id"]), r["text"]) for r in kept.collect()) == want
    single = stages["near_duplicates"](spark, kept, FOLDER)
    assert single.columns == docs.columns
    assert sorted((str(r["doc_id"]), r["text"]) for r in single.collect()) == sorted(set(want) - {("5001", texts[0][1])})
    clean = stages["repeated_passages"](spark, single, FOLDER)
    got = {r["doc_id"]: r["text"] for r in clean.collect() if r["doc_id"] is not None}
    assert clean.columns == docs.columns and clean.count() == single.count()
    assert passage in got[5005] and passage not in got[5006] and got[5007] == dict(texts)[5007]
    mixed = stages["source_mix"](spark, clean, FOLDER)
    assert mixed.columns == docs.columns and 0 < mixed.count() <= 3 * clean.count()
    model = sentencepiece.SentencePieceProcessor(model_file=tokenizer_path("piece_bpe_32k.model"))
    last = stages["encode"](spark, clean, FOLDER).collect()
    assert {r["doc_id"]: r["ids"] for r in last if r["doc_id"] is not None} == {k: model.encode(t) for k, t in got.items()}


def test_pipeline_of_an_empty_table(spark):
    docs = odd_table(spark)[0].limit(0)
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, FOLDER)
        assert out.collect() == [] and (name == "encode" or out.columns == docs.columns), name
