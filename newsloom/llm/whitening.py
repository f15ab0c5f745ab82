"""Whitening of vectors by an exact covariance from bit-sliced popcounts.

Entries become integers. A task shifts each dimension so that none is negative,
packs every bit plane of it across the rows into 64-bit words, and gets the
cross-products of two dimensions as the popcounts of AND-ed planes, weighted by
the planes' places. These sums are whole numbers, so they add up over tasks in
any order to the same result; the covariance is centred as integers too and
becomes floating point only for the eigendecomposition.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from newsloom.llm.words import fresh
from newsloom.session import written

SCALE = 256
#: Sums travel as a low part of this many bits and the rest, so that neither overflows.
LOW = 60
#: Products of whitened entries are measured in steps of 2**-20, whose sum does not depend on its order.
STEP = 1 << 20


class Model(NamedTuple):
    """What the rows of one length need: their number, sums, scaled eigenvectors, shares and error."""

    n: int
    sums: list[int]
    axes: np.ndarray
    explained: list[float]
    error: float | None


def long_vector(vector: Column) -> Column:
    """floor(256 c) of each entry as long; null where the vector or an entry is null or not finite, or it has no entry.

    Entries beyond a long become the nearest long.
    """
    entries = vector.cast("array<double>")
    finite = F.forall(entries, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf"))))
    return F.when(finite & (F.size(entries) > 0), F.transform(entries, lambda c: F.floor(c * SCALE)))


def by_length(vectors: pa.Array) -> Iterator[tuple[pa.Array, np.ndarray]]:
    """(places, matrix of long) for the vectors of each length."""
    lengths = pc.list_value_length(vectors).to_numpy(zero_copy_only=False)
    for d in np.unique(lengths).tolist():
        places = pa.array(np.flatnonzero(lengths == d))
        yield places, vectors.take(places).flatten().to_numpy().reshape(-1, d)


def bit_planes(y: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Planes of the columns of unsigned numbers, 64 rows to a word: words, the first plane of each column, place values."""
    widths = np.array([max(1, int(top).bit_length()) for top in y.max(axis=0)])
    first = np.cumsum(widths) - widths
    bits = np.zeros((widths.sum(), -(-len(y) // 64) * 64), np.uint8)
    for column, (at, width) in enumerate(zip(first.tolist(), widths.tolist(), strict=True)):
        for b in range(width):
            bits[at + b, : len(y)] = (y[:, column] >> np.uint64(b)) & np.uint64(1)
    places = np.arange(widths.sum()) - np.repeat(first, widths)
    return np.packbits(bits, axis=1).view(np.uint64), first, places


def cross_products(y: np.ndarray) -> np.ndarray:
    """Sum over the rows of y_i * y_j for all columns i, j of unsigned numbers, exact."""
    words, first, places = bit_planes(y)
    counts = np.zeros((len(words), len(words)), np.int64)
    for a in range(len(words)):
        counts[a, a:] = np.bitwise_count(words[a] & words[a:]).sum(axis=1, dtype=np.int64)
        counts[a:, a] = counts[a, a:]
    if 2 * (int(places.max()) + 1) + len(y).bit_length() > 62:
        counts, value = counts.astype(object), np.array([1 << p for p in places.tolist()], object)
    else:
        value = np.int64(1) << places
    weighted = counts * value[:, None] * value[None, :]
    return np.add.reduceat(np.add.reduceat(weighted, first, axis=0), first, axis=1).astype(object)


def scatter(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sums and cross-products of the columns of long numbers as Python integers."""
    low = x.min(axis=0)
    y = x.view(np.uint64) - low.view(np.uint64)
    m, rows = low.astype(object), len(x)
    sums = (y >> np.uint64(32)).sum(axis=0).astype(object) * (1 << 32) + (y & np.uint64(0xFFFFFFFF)).sum(axis=0).astype(object)
    crossed = cross_products(y) + np.outer(m, sums) + np.outer(sums, m) + rows * np.outer(m, m)
    return sums + rows * m, crossed


def totals(distinct: DataFrame) -> dict[int, tuple[int, np.ndarray, np.ndarray]]:
    """Per length: number of vectors, sums and cross-products. What reaches the driver grows with the dimensions only."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list] = {}
        for batch in batches:
            for _, x in by_length(batch.column(0)):
                mine = held.setdefault(x.shape[1], [0, 0, 0])
                sums, crossed = scatter(np.ascontiguousarray(x))
                held[x.shape[1]] = [mine[0] + len(x), mine[1] + sums, mine[2] + crossed]
        for d, (n, sums, crossed) in held.items():
            i, j = np.triu_indices(d)
            values = [n, *sums.tolist(), *crossed[i, j].tolist()]
            yield pa.RecordBatch.from_pydict(
                {
                    "d": pa.array([d] * len(values), pa.int32()),
                    "i": pa.array([-1] * (d + 1) + i.tolist(), pa.int32()),
                    "j": pa.array([-1, *range(d), *j.tolist()], pa.int32()),
                    "low": pa.array([v & ((1 << LOW) - 1) for v in values], pa.int64()),
                    "high": pa.array([v >> LOW for v in values], pa.decimal128(38, 0)),
                }
            )

    sums = distinct.mapInArrow(run, "d int, i int, j int, low long, high decimal(38,0)").groupBy("d", "i", "j")
    sums = sums.agg(F.sum(F.col("low").cast("decimal(28,0)")).alias("low"), F.sum("high").alias("high"))
    out: dict[int, tuple] = {}
    for d, i, j, low, high in sums.toLocalIterator():
        n, s, crossed = out.setdefault(d, ([0], np.zeros(d, object), np.zeros((d, d), object)))
        value = int(low) + (int(high) << LOW)
        if j < 0:
            n[0] = value
        elif i < 0:
            s[j] = value
        else:
            crossed[i, j] = crossed[j, i] = value
    return {d: (n[0], s, crossed) for d, (n, s, crossed) in out.items()}


def covariance(n: int, sums: np.ndarray, crossed: np.ndarray) -> np.ndarray:
    """Divisor n, centred as integers; each entry is the double next to the exact quotient."""
    return ((n * crossed - np.outer(sums, sums)) / (n * n)).astype(float)


def principal(v: np.ndarray, components: int) -> tuple[np.ndarray, list[float]]:
    """Eigenvectors by falling eigenvalue, each over the root of it, and shares of the trace.

    The largest entry of each eigenvector is positive. Where the data have no
    spread left, the column is NaN and the share 0.
    """
    values, vectors = np.linalg.eigh(v)
    order = np.argsort(-values, kind="stable")[:components]
    values, vectors = values[order], vectors[:, order]
    vectors = vectors * np.where(vectors[np.abs(vectors).argmax(axis=0), range(len(order))] < 0, -1.0, 1.0)
    spread = values > len(v) * np.finfo(float).eps * max(values.max(), 0.0)
    axes = np.where(spread, vectors / np.sqrt(np.where(spread, values, 1.0)), np.nan)
    trace = float(np.trace(v))
    return axes, [float(e) / trace if s else 0.0 for e, s in zip(values, spread, strict=True)]


def centred(x: np.ndarray, n: int, sums: list[int]) -> np.ndarray:
    """n x - S as integers: long where all fit, else Python integers."""
    reach = max(abs(int(x.max())), abs(int(x.min()))) * n + max(map(abs, sums))
    if reach < 1 << 62:
        return x * np.int64(n) - np.array(sums, np.int64)
    return x.astype(object) * n - np.array(sums, object)


def projected(t: np.ndarray, model: Model) -> np.ndarray:
    """Rows of n x - S on the axes; the sum of a row does not depend on the rows beside it."""
    away = (t / model.n).astype(float)
    return np.stack([(away * model.axes[:, c]).sum(axis=1) for c in range(model.axes.shape[1])], axis=1)


def deviations(t: np.ndarray) -> list[int]:
    """Sum of squares of each row, exact."""
    most = max(int(t.max()), -int(t.min()))
    if most * most * t.shape[1] < 1 << 63:
        return (t * t).sum(axis=1).tolist()
    return (t.astype(object) ** 2).sum(axis=1).tolist()


def identity_errors(distinct: DataFrame, models: dict[int, Model]) -> dict[int, float]:
    """Per length the largest absolute entry of the whitened vectors' covariance less the identity, measured on the vectors."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, x in by_length(batch.column(0)):
                model = models[x.shape[1]]
                w = projected(centred(x, model.n, model.sums), model)
                i, j = np.triu_indices(w.shape[1])
                steps = np.rint(np.nan_to_num(w[:, i] * w[:, j]) * STEP).astype(np.int64).sum(axis=0)
                size = np.full(len(i), x.shape[1])
                yield pa.RecordBatch.from_pydict({"d": size.astype(np.int32), "i": i.astype(np.int32), "j": j.astype(np.int32), "steps": steps})

    sums = distinct.mapInArrow(run, "d int, i int, j int, steps long").groupBy("d", "i", "j").agg(F.sum("steps").alias("steps"))
    out: dict[int, float] = {}
    for d, i, j, steps in sums.toLocalIterator():
        if not (np.isnan(models[d].axes[0, i]) or np.isnan(models[d].axes[0, j])):
            out[d] = max(out.get(d, 0.0), abs(steps / STEP / models[d].n - (i == j)))
    return out


def fit(vectors: DataFrame, vector: str, components: int) -> dict[int, Model]:
    """A model per length of vector from each distinct vector of long numbers once.

    Copies are reduced in each task before the shuffle; the distinct vectors are a table.
    """
    distinct = written(vectors.select(vector).distinct(), "whitening-distinct")
    models = {}
    for d, (n, sums, crossed) in totals(distinct).items():
        axes, explained = principal(covariance(n, sums, crossed), components)
        models[d] = Model(n, sums.tolist(), axes, explained, None)
    errors = identity_errors(distinct, models)
    return {d: model._replace(error=errors.get(d)) for d, model in models.items()}


COMPONENT = "struct<component:int,whitened:double,explained:double>"


def whitened(rows: DataFrame, vector: str = "embedding", components: int = 4) -> DataFrame:
    """Rows with a usable vector, all columns, and a last column `whitening`.

    `whitening` has `n` (distinct vectors fitted on), `deviation` (sum of the
    squares of n x - S, exact, as decimal; null beyond 38 digits),
    `identity_error` and `components`, an array of component number from 1,
    whitened entry and share of the trace. Rows whose vector is null or empty,
    or has a null or non-finite entry, are dropped. Vectors of another length
    are whitened among themselves. A component in which the data have no
    spread (all vectors equal, or fewer vectors than dimensions) has a null
    entry and share 0; with no component left the error is null. Repeated rows
    each get a row, and count once in the fit. An empty table gives no rows.
    Where `rows` has a column `whitening` the new one gets underscores in front.
    """
    x, name = fresh(rows, "_long"), fresh(rows, "whitening")
    usable = rows.withColumn(x, long_vector(F.col(vector))).filter(F.col(x).isNotNull())
    models = fit(usable, x, components)
    kind = f"struct<n:bigint,deviation:decimal(38,0),identity_error:double,components:array<{COMPONENT}>>"
    result = rows.withColumn(name, F.lit(None).cast(kind)).schema
    part = pa.struct([("component", pa.int32()), ("whitened", pa.float64()), ("explained", pa.float64())])
    whole = pa.struct([("n", pa.int64()), ("deviation", pa.decimal128(38, 0)), ("identity_error", pa.float64()), ("components", pa.list_(part))])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = len(result) - 1
        for batch in batches:
            for places, values in by_length(batch.column(last)):
                model = models[values.shape[1]]
                t = centred(values, model.n, model.sums)
                w = projected(t, model)
                k, size = w.shape[1], len(w)
                parts = pa.StructArray.from_arrays(
                    [
                        pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), size)),
                        pa.array(w.ravel(), from_pandas=True),
                        pa.array(np.tile(model.explained, size)),
                    ],
                    fields=list(part),
                )
                lists = pa.ListArray.from_arrays(pa.array(np.arange(size + 1) * k, pa.int32()), parts)
                exact = [v if v < 10**38 else None for v in deviations(t)]
                numbers = pa.array(np.full(size, model.n)), pa.array(exact, pa.decimal128(38, 0)), pa.array([model.error] * size, pa.float64())
                struct = pa.StructArray.from_arrays([*numbers, lists], fields=list(whole))
                yield pa.RecordBatch.from_arrays([*(batch.column(i).take(places) for i in range(last)), struct], result.names)

    return usable.mapInArrow(run, result)
