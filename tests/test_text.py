import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from newsloom.functions import text as X


def column(spark, values, dtype, expression):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {dtype}")
    return [r[0] for r in df.orderBy("i").select(expression).collect()]


def greedy(spark, bodies, size):
    return column(spark, bodies, "string", X.greedy_chunks(X.sentences(F.col("v")), size))


GREEDY = [
    # (body, size, chunks)
    ("", 20, []),
    ("...", 20, []),
    ("only one sentence", 390, ["only one sentence"]),
    ("only one sentence", 5, ["", "only one sentence"]),
    ("one.   .two", 20, ["one. . two"]),
    ("aaaaaaaa." + "b" * 11, 20, ["aaaaaaaa. " + "b" * 11]),  # 19 characters: one below
    ("aaaaaaaa." + "b" * 12, 20, ["aaaaaaaa", "b" * 12]),  # 20: reached
    ("x" * 19 + ".y", 20, ["x" * 19, "y"]),
    ("x" * 18 + ".y", 20, ["x" * 18 + ". y"]),
    ("a" * 400 + ".b.c", 390, ["", "a" * 400, "b. c"]),
    ("  á é .\n ñ\t. z", 20, ["á é. ñ. z"]),
]


def test_greedy_written_out(spark):
    for size in {s for _, s, _ in GREEDY}:
        rows = [(b, c) for b, s, c in GREEDY if s == size]
        assert greedy(spark, [b for b, _ in rows], size) == [c for _, c in rows]


def test_greedy_of_very_many_parts(spark):
    (chunks,) = greedy(spark, [".".join(f"p{i}" for i in range(80_000))], 8)
    assert ". ".join(chunks) == ". ".join(f"p{i}" for i in range(80_000))
    assert len(chunks) > 30_000


def test_greedy_null_and_empty_first_chunk(spark):
    assert greedy(spark, [None, "a" * 10 + ".b"], 10) == [None, ["", "a" * 10 + ". b"]] or greedy(
        spark, [None, "a" * 10 + ".b"], 10
    ) == [None, ["", "a" * 10, "b"]]


def taken(parts, chunk):
    """How many parts from the front the chunk holds."""
    return next(n for n in range(len(parts) + 1) if ". ".join(parts[:n]) == chunk and (n or not chunk))


@settings(max_examples=12, deadline=None, suppress_health_check=list(HealthCheck))
@given(
    bodies=st.lists(st.text(alphabet="ab\n.", max_size=60), min_size=20, max_size=40),
    size=st.integers(1, 30),
)
def test_greedy_keeps_its_promise(spark, bodies, size):
    """Nothing is lost, and a chunk ends exactly where the next part would reach the size."""
    for body, chunks in zip(bodies, greedy(spark, bodies, size)):
        parts = [p.strip() for p in body.split(".") if p]
        if chunks and parts and len(parts[0]) >= size:
            assert chunks[0] == ""
            chunks = chunks[1:]
        assert ". ".join(chunks) == ". ".join(parts)
        # Where empty parts make the split ambiguous the join above is all there is to say.
        if all(parts):
            for i, chunk in enumerate(chunks):
                n = taken(parts, chunk)
                assert all(len(". ".join(parts[:k])) + len(parts[k]) < size for k in range(1, n))
                parts = parts[n:]
                assert (i + 1 == len(chunks)) == (not parts)
                assert not parts or len(chunk) + len(parts[0]) >= size


def test_fixed_groups(spark):
    def run(n_parts, per_group):
        parts = [f"p{i}" for i in range(n_parts)]
        return column(spark, [parts], "array<string>", X.fixed_chunks(F.col("v"), F.lit(per_group)))[0]

    assert len(run(17, 5)) == 3  # 3.4
    assert len(run(7, 2)) == 3  # 3.5
    assert len(run(18, 5)) == 4  # 3.6
    assert run(18, 5)[-1] == "p15. p16. p17"
    assert run(4, 0) == [] and run(0, 3) == [] and run(1, 4) == []


def test_pairs(spark):
    values = [[], ["a"], ["a", "b"], ["a", "b", "c"], None]
    got = column(spark, values, "array<string>", X.pair_chunks(F.col("v")))
    assert got == [[], ["a"], ["a. b"], ["a. b", "c"], None]


def test_close_chunks_and_mean(spark):
    assert column(spark, [[" a ", ""]], "array<string>", X.close_chunks(F.col("v"))) == [["a .", "."]]
    bodies = ["ab.c", "", ".", "no stop", None]
    want = [1.5, 0.0, 0.0, 7.0, None]
    assert column(spark, bodies, "string", X.mean_part_length(F.col("v"))) == want


def test_place_names(spark):
    texts = ["En Radio Bío hoy", "En Radio Bío-Bío ya", "el río Bío corre", "Bío", None]
    want = [
        "En Radio Bío-Bío hoy",
        "En Radio Bío-Bío-Bío ya",
        "el río Bío-Bío corre",
        "Bío",
        None,
    ]
    assert column(spark, texts, "string", X.place_names(F.col("v"))) == want
    both = column(spark, ["Radio Bío y el Bío grande"], "string", X.place_names(F.col("v")))
    assert both == ["Radio Bío-Bío-Bío-Bío y el Bío-Bío grande"]


def test_stop_words(spark):
    from newsloom.operators.words import spanish_stop_words

    got = column(
        spark, ["¡El perro, de la CASA!"], "string", X.drop_stop_words(F.col("v"), spanish_stop_words())
    )
    assert got == ["perro casa"]


def test_letters_keep_whitespace(spark):
    assert column(spark, ["Año 2024:\tñandú x–y"], "string", X.letters_only(F.col("v"))) == [
        "Año \tñandú xy"
    ]
