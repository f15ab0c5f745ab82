"""Whitening against exact integers and a plain eigendecomposition."""

from fractions import Fraction

import numpy as np
import pytest

from newsloom.llm import whitening


def slow(vectors, components=4):
    """(n, per-vector deviation, whitened) with fractions, from vectors of usable entries."""
    x = [[int(np.floor(256.0 * c)) for c in v] for v in vectors]
    fit = [list(v) for v in {tuple(v) for v in x}]
    n, d = len(fit), len(fit[0])
    sums = [sum(v[i] for v in fit) for i in range(d)]
    cov = [[float(sum((Fraction(v[i]) - Fraction(sums[i], n)) * (v[j] - Fraction(sums[j], n)) for v in fit) / n) for j in range(d)] for i in range(d)]
    e, vec = np.linalg.eigh(np.array(cov))
    e, vec = e[::-1][:components], vec[:, ::-1][:, :components]
    away = np.array([[float(Fraction(a) - Fraction(s, n)) for a, s in zip(v, sums, strict=True)] for v in x])
    return n, [sum((n * a - s) ** 2 for a, s in zip(v, sums, strict=True)) for v in x], away @ vec / np.sqrt(e), e / np.trace(cov)


def frame(spark, rows, kind="double"):
    return spark.createDataFrame(rows, f"vec_id long, embedding array<{kind}>, whitening int, _long string")


def test_cross_products_are_exact():
    rng = np.random.default_rng(0)
    for top in (1, 2, 1000, 2**40, 2**64 - 1):
        y = rng.integers(0, top, (150, 5), dtype=np.uint64, endpoint=True)
        y[:, 2] = 0
        big = y.astype(object)
        assert (whitening.cross_products(y) == big.T @ big).all()
    x = rng.integers(-(2**63), 2**63 - 1, (70, 3), dtype=np.int64)
    sums, crossed = whitening.scatter(x)
    big = x.astype(object)
    assert (sums == big.sum(axis=0)).all() and (crossed == big.T @ big).all()


def test_whitened_against_fractions(spark):
    rng = np.random.default_rng(1)
    base = rng.normal(0, 0.3, (300, 7)) @ rng.normal(0, 1, (7, 7))
    good = base.tolist() + base[:40].tolist() + [base[0].tolist()] * 30
    rows = [(i, v, i, "x") for i, v in enumerate(good)]
    bad = [(900, None, 1, None), (901, [1.0, None] + [0.0] * 5, 1, None), (902, [float("nan")] * 7, 1, None), (903, [float("-inf")] * 7, 1, None), (904, [], 1, None)]
    df = frame(spark, rows + bad + [(None, good[0], None, None)])
    got = whitening.whitened(df)
    assert got.columns == ["vec_id", "embedding", "whitening", "_long", "_whitening"]
    got = got.collect()
    assert len(got) == len(good) + 1
    n, deviation, white, explained = slow(good)
    for r in got:
        w = r["_whitening"]
        i = 0 if r.vec_id is None else r.vec_id
        assert w.n == n == 300 and int(w.deviation) == deviation[i] and w.identity_error < 1e-5
        assert [c.component for c in w.components] == [1, 2, 3, 4]
        assert np.allclose(np.abs([c.whitened for c in w.components]), np.abs(white[i]), atol=1e-9)
        assert np.allclose([c.explained for c in w.components], explained, rtol=1e-9)
    signs = np.sign([[c.whitened for c in r["_whitening"].components] for r in got if r.vec_id is not None]) * np.sign(white[[r.vec_id for r in got if r.vec_id is not None]])
    assert (signs == signs[0]).all()


def test_no_spread_other_lengths_and_empty(spark):
    rows = [(1, [1.0, 2.0], 0, ""), (2, [1.0, 2.0], 0, ""), (3, [0.0, 0.5, 3.0], 0, ""), (4, [0.0, 0.5, 4.0], 0, "")]
    got = {r.vec_id: r["_whitening"] for r in whitening.whitened(frame(spark, rows)).collect()}
    assert got[1].n == 1 and got[1].deviation == 0 and got[1].identity_error is None
    assert [(c.whitened, c.explained) for c in got[1].components] == [(None, 0.0)] * 2
    assert got[3].n == 2 and got[3].deviation == 256**2 and abs(abs(got[3].components[0].whitened) - 1) < 1e-12
    assert got[3].components[0].explained == 1.0 and got[3].components[1].whitened is None and got[4].identity_error < 1e-5
    assert whitening.whitened(frame(spark, [])).collect() == []


def test_huge_entries(spark):
    rows = [(1, [1e300, 1.0], 0, ""), (2, [-1e300, 2.0], 0, ""), (3, [0.0, -0.0], 0, "")]
    got = {r.vec_id: r["_whitening"] for r in whitening.whitened(frame(spark, rows)).collect()}
    assert got[1].n == 3 and got[1].deviation is None and got[3].deviation is not None
    assert got[1].identity_error < 1e-5


@pytest.mark.parametrize("kind", ["float", "double"])
def test_query_shape(spark, tmp_path, kind):
    from newsloom.llm.queries import QUERIES

    rng = np.random.default_rng(2)
    rows = [(i, v, 0, "") for i, v in enumerate(rng.normal(0, 0.2, (50, 6)).astype(np.float32).astype(float).tolist())]
    frame(spark, rows, kind).write.parquet(str(tmp_path / "embeddings.parquet"))
    got = QUERIES["op13_embedding_whitening"](spark, str(tmp_path))
    assert [f"{f.name}:{f.dataType.simpleString()}" for f in got.schema][:4] == ["vec_id:bigint", "component:int", "n:bigint", "deviation:bigint"]
    got = got.collect()
    n, deviation, white, _ = slow([r[1] for r in rows])
    assert len(got) == 200 and {r.n for r in got} == {n}
    for r in got:
        assert r.deviation == deviation[r.vec_id] and abs(abs(r.whitened) - abs(white[r.vec_id][r.component - 1])) < 1e-9
