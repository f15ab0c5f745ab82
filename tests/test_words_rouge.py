import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from newsloom.functions import rouge
from newsloom.functions.rouge import common_length, common_lengths, pair_scores, rouge_score, stemmer, token_list
from newsloom.functions.stemming import porter_stem
from newsloom.operators import evaluation as E
from newsloom.operators import words as W
from newsloom.operators.summarise import model_logits, summary_checks


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sampled_from("abcd"), max_size=9), st.lists(st.sampled_from("abcde"), max_size=30))
def test_common_length(a, b):
    inside = lambda part, whole: all(x in whole for whole in [iter(whole)] for x in part)
    longest = 0
    for mask in range(1 << len(a)):
        part = [x for i, x in enumerate(a) if mask >> i & 1]
        if len(part) > longest and inside(part, b):
            longest = len(part)
    assert common_length(a, b) == longest == common_length(b, a)


def test_stems():
    # Published examples of the algorithm.
    pairs = {
        "caresses": "caress", "ponies": "poni", "ties": "tie", "cats": "cat", "feed": "feed",
        "agreed": "agre", "plastered": "plaster", "motoring": "motor", "sing": "sing",
        "conflated": "conflat", "troubled": "troubl", "sized": "size", "hopping": "hop",
        "falling": "fall", "hissing": "hiss", "failing": "fail", "filing": "file", "happy": "happi",
        "sky": "sky", "relational": "relat", "conditional": "condit", "rational": "ration",
        "valency": "valenc", "digitizer": "digit", "operator": "oper", "feudalism": "feudal",
        "hopefulness": "hope", "formality": "formal", "sensibility": "sensibl",
        "triplicate": "triplic", "formative": "form", "electrical": "electr", "goodness": "good",
        "revival": "reviv", "allowance": "allow", "airliner": "airlin", "adjustable": "adjust",
        "replacement": "replac", "adoption": "adopt", "homologous": "homolog", "rate": "rate",
        "probate": "probat", "cease": "ceas", "controlling": "control", "roll": "roll",
        "news": "news", "dying": "die", "enjoy": "enjoy", "spied": "spi", "died": "die",
    }
    assert {w: porter_stem(w) for w in pairs} == pairs


def test_tokens():
    assert token_list("Año NUEVO, 2024-x", None) == ["a", "o", "nuevo", "2024", "x"]
    assert token_list("The cats running", stemmer(True)) == ["the", "cat", "run"]
    assert token_list("dies", stemmer(True)) == ["die"] and token_list("ies", stemmer(True)) == ["ies"]


def test_rouge_cases(spark):
    pairs = [
        (0, "the cat sat", "the cat sat"),
        (1, "a b", "c d"),
        (2, "a b c", ""),
        (3, "", ""),
        (4, "b a a c", "a a a b"),
        (5, None, "x"),
        (6, "canción del río", "cancion del rio"),
    ]
    df = spark.createDataFrame(pairs, "id int, ref string, hyp string")
    bag = {r.id: r for r in E.rouge1(df, ["id"], "ref", "hyp").collect()}
    rows = df.select("id", rouge_score(F.col("ref"), F.col("hyp"), stem=False).alias("s")).collect()
    for r in rows:
        ref, hyp = pairs[r.id][1:]
        want = pair_scores(ref, hyp)
        for field in ("precision", "recall", "fmeasure"):
            assert bag[r.id][field] == pytest.approx(want["rouge1"][field])
            assert r.s.rougeL[field] == pytest.approx(want["rougeL"][field])
    assert bag[0].fmeasure == 1 and bag[1].fmeasure == 0 and bag[4].overlap == 3
    assert rows[4].s.rougeL.recall == 0.5


def test_repairs_written_out(spark):
    rows = [
        # (article, summary, repaired)
        ("casa gris", "desconocida casa", "desconocida casa"),  # no rare words to take
        ("los trapiales", "trapial", "trapial"),  # a part of an article's word stays
        ("abc abd", "abz en Radio Bío", "abc en Radio Bío-Bío"),  # equal distance: the first
        ("zorro", "zorra zorra", "zorro zorro"),
        ("ñandú Tomé lota", "nandú y Tome", "ñandú Tomé Tomé"),  # "y": four letters from Tomé and from lota
        ("perro gris", "los perros, gris", "los perro, gris"),
        ("lota Lotas", "lotaz Lotasz", "lota Lotas"),
        ("casa", "de Bío en", "de Bío-Bío en"),
        ("", "algo", "algo"),
        (None, "nada", "nada"),
        ("algo", None, ""),
    ]
    known = spark.createDataFrame([(w,) for w in ("casa", "gris", "los", "en", "de", "radio", "bío")], "word string")
    df = spark.createDataFrame([(i, a, s) for i, (a, s, _) in enumerate(rows)], "id int, article string, summary string")
    got = {r.id: r.repaired for r in W.repair_summaries(df, ["id"], "article", "summary", known).collect()}
    assert got == {i: r for i, (_, _, r) in enumerate(rows)}


def test_repaired_words_come_from_the_article(spark):
    rng = random.Random(3)
    vocabulary = ["perro", "ñandú", "tomé", "trapial", "lota", "gris"]
    text = lambda n, ends: " ".join(rng.choice(vocabulary) + rng.choice(ends) for _ in range(n))
    pairs = [(i, text(25, ["", "s"]), text(8, ["", "z"])) for i in range(40)]
    df = spark.createDataFrame(pairs, "id int, article string, summary string")
    none = spark.createDataFrame([], "word string")
    for r in W.repair_summaries(df, ["id"], "article", "summary", none).collect():
        article, summary = pairs[r.id][1:]
        assert all(w in article for w in r.repaired.split())
        assert len(r.repaired.split()) == len(summary.split())


def test_rare_words(spark):
    df = spark.createDataFrame([(1, "La casa, la Xilófona xilófona")], "id int, text string")
    known = spark.createDataFrame([("LA",), ("casa",)], "word string")
    rows = W.rare_words(df, ["id"], "text", known).orderBy("pos").collect()
    assert [(r.pos, r.word) for r in rows] == [(3, "Xilófona"), (4, "xilófona")]


def test_sentiment(spark):
    df = spark.createDataFrame([(1, "Bueno malo malo"), (2, "nada"), (3, None)], "id int, text string")
    lexicon = spark.createDataFrame(
        [("malo", 1.0, 0.0), ("bueno", 0.0, 1.0)], "word string, negative double, positive double"
    )
    logits = W.lexicon_logits(df, ["id"], "text", lexicon)
    rows = {r.id: r for r in W.sentiment(logits).collect()}
    assert (rows[1].logit_neg, rows[1].logit_pos) == (2.0, 1.0)
    assert rows[1].negative == pytest.approx(0.7310585786) and rows[2].negative == 0.5
    assert rows[3].positive == 0.5

    def load():
        return lambda texts: [(len(t or ""), 0.0) for t in texts]

    model = model_logits(df, ["id"], "text", load)
    assert {r.id: r.logit_neg for r in model.collect()} == {1: 15.0, 2: 4.0, 3: 0.0}


def test_summary_checks(spark):
    texts = ["Título\na\nb", "T\n" + "x\n" * 6, "T\n" + "w " * 100, "T", ""]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id int, summary string")
    rows = summary_checks(df).orderBy("id").collect()
    assert [(r.n_bullets, r.n_words, r.is_valid) for r in rows] == [
        (2, 3, True), (6, 7, False), (1, 101, False), (0, 1, True), (0, 0, True),
    ]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.lists(st.sampled_from("abcd"), max_size=200), st.lists(st.sampled_from("abcde"), max_size=90)), max_size=12))
def test_common_lengths_of_many_pairs(pairs):
    a, b = [list(x) for x, _ in pairs], [list(y) for _, y in pairs]
    want = [common_length(x, y) for x, y in zip(a, b, strict=True)]
    assert common_lengths(a, b) == want == common_lengths(b, a)


def test_common_lengths_in_parts(monkeypatch):
    rng = random.Random(8)
    monkeypatch.setattr(rouge, "_CELLS", 5000)
    pairs = [([rng.choice("abcdefgh") for _ in range(rng.randrange(300))], [rng.choice("abcdefgh") for _ in range(rng.randrange(700))]) for _ in range(60)]
    a, b = zip(*pairs, strict=True)
    assert common_lengths(list(a), list(b)) == [common_length(x, y) for x, y in pairs]
    long = ["x"] * 20000 + ["y"] + ["z"] * 3000
    assert common_lengths([long], [long[1:-1] + ["q"]]) == [len(long) - 2]


def test_scores_of_arrays(spark):
    """Pairs that one text settles and pairs that it does not, stems or not, nulls and unequal arrays."""
    rng = random.Random(9)
    words = ["cats", "cat", "running", "run", "a", "the", "sat", "mat", "ponies"]
    text = lambda n: " ".join(rng.choice(words) for _ in range(n))
    rows = [(i, [text(rng.randrange(12)) for _ in range(4)], [text(rng.randrange(8)) for _ in range(4)]) for i in range(40)]
    rows += [(50, ["the cat sat"], ["cat sat"]), (51, ["a"], ["the a b"]), (52, ["", "x"], ["", None]), (53, None, ["a"]), (54, ["a", "b"], ["a"]), (55, [], [])]
    df = spark.createDataFrame(rows, "i int, r array<string>, h array<string>")
    for stem in (True, False):
        got = {x.i: x.scores for x in E.add_scores(df, "r", "h", stem).collect()}
        one = {x.i: x.scores for x in E.add_scores(df, "r", "h", stem, ("rouge1",)).collect()}
        cut = stemmer(stem)
        for i, r, h in rows:
            want = None if r is None else [pair_scores(a, b, cut) for a, b in zip(r, h)]
            assert (got[i] and [x.asDict(True) for x in got[i]]) == want, (i, stem)
            assert (one[i] and [x.asDict(True) for x in one[i]]) == (want and [{"rouge1": w["rouge1"]} for w in want])
    plan = E.add_scores(df, "r", "h", False, ("rouge1",))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan


def slow_nearest(word, candidates):
    def edits(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            row, last = [i], row
            for j, y in enumerate(b, 1):
                row.append(min(last[j] + 1, row[-1] + 1, last[j - 1] + (x != y)))
        return row[-1]

    return min(range(len(candidates)), key=lambda i: (edits(word, candidates[i]), i), default=None)


def test_word_places(spark):
    df = spark.createDataFrame([(1, ["b", "a", "b", "", "B"]), (2, []), (3, ["x"])], "i int, w array<string>")
    got = {r.i: [(x.word, x.places) for x in r.p] for r in df.select("i", W.word_places(F.col("w")).alias("p")).collect()}
    assert got == {1: [("", [3]), ("B", [4]), ("a", [1]), ("b", [0, 2])], 2: [], 3: [("x", [0])]}


def test_nearest_word_in_a_row(spark):
    rng = random.Random(10)
    word = lambda n: "".join(rng.choice("abcñ") for _ in range(n))
    rows = [(i, word(rng.randrange(1, 9)), [word(rng.randrange(1, 9)) for _ in range(rng.randrange(12))]) for i in range(150)]
    df = spark.createDataFrame(rows, "i int, w string, c array<string>")
    got = {r.i: r.n for r in df.select("i", W.nearest_word(F.col("w"), F.col("c")).alias("n")).collect()}
    for i, w, c in rows:
        at = slow_nearest(w, c)
        assert got[i] == (None if at is None else c[at])


def test_index_finds_all_close_words(spark):
    rng = random.Random(11)
    word = lambda n: "".join(rng.choice("abcdé") for _ in range(n))
    rows = [(i if i else None, [word(rng.randrange(1, 8)) for _ in range(6)] + ["x" * 21, "x" * 20], [word(rng.randrange(1, 8)) for _ in range(8)] + ["x" * 22]) for i in range(30)]
    df = spark.createDataFrame(rows, "k int, a array<string>, c array<string>")
    got = {r.k: {x.word: x.nearest for x in r.close} for r in W.close_words(df, ["k"], "a", "c").collect()}
    for k, asked, candidates in rows:
        for w in set(asked):
            near = candidates[slow_nearest(w, candidates)]
            close = _edits(w, near) <= 2 and len(w) <= 20
            assert (got.get(k, {}).get(w) == near) if close else (w not in got.get(k, {}))


def _edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, last = [i], row
        for j, y in enumerate(b, 1):
            row.append(min(last[j] + 1, row[-1] + 1, last[j - 1] + (x != y)))
    return row[-1]


def test_repairs_do_not_depend_on_the_index(spark, monkeypatch):
    rng = random.Random(13)
    word = lambda: "".join(rng.choice("abcd") for _ in range(rng.randrange(2, 9)))
    rows = [(i, " ".join(word() for _ in range(30)), " ".join(word() for _ in range(30))) for i in range(20)]
    pairs = spark.createDataFrame(rows, "k int, article string, summary string")
    repairs = lambda: sorted((r.k, r.repairs) for r in W.word_repairs(pairs, ["k"], "article", "summary", spark.createDataFrame([("a",)], "word string")).collect())
    direct = repairs()
    monkeypatch.setattr(W, "MANY", 1)
    assert repairs() == direct and any(r for _, r in direct)


def test_repairs_of_a_long_article(spark):
    """5,000 rare words in one article, and summary words near to, and far from, all of them."""
    rng = random.Random(12)
    rare = list(dict.fromkeys("".join(rng.choice("bcdfgaeiou") for _ in range(rng.randrange(5, 12))) for _ in range(5200)))[:5000]
    bent = [w[:2] + "z" + w[3:] for w in rare[100:140]] + ["zzzzzzzzzzzzzzzz", "qwxyzqwxyzqwxyz"] * 2
    pairs = spark.createDataFrame([(1, " ".join(rare), " ".join(bent)), (2, "known", "strange"), (3, None, None)], "k int, article string, summary string")
    got = {r.k: [(x.word, x.nearest) for x in r.repairs] for r in W.word_repairs(pairs, ["k"], "article", "summary", spark.createDataFrame([("known",)], "word string")).collect()}
    seen = {w: rare[slow_nearest(w, rare)] for w in dict.fromkeys(bent[:5] + bent[-4:])}
    assert [w for w, _ in got[1]] == bent and all(n == seen[w] for w, n in got[1] if w in seen)
    assert got[2] == [("strange", None)] and got[3] == []
