"""Toxicity: a convolutional text classifier, trained in numpy and applied in Arrow batches.

Words are hashed twice into embedding tables and add up their two rows, so a
chance collision in one table gives half a word. Filters of several widths
slide over a text, each gives its highest value anywhere in it, and a logistic
layer turns these into a score.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from newsloom.session import scratch_path


#: Odd, so it has an inverse; powers of both give the hash of any run of bytes from one running sum.
BASE = 0x9E3779B97F4A7C15
WIDTHS = (1, 2, 3)
PAD = max(WIDTHS) - 1
#: ASCII letters and digits and every byte of a longer character are in words.
IN_WORD = np.array([chr(b).isalnum() if b < 128 else True for b in range(256)])


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base & (2**64 - 1), np.uint64)
    out[:1] = 1
    return np.cumprod(out, dtype=np.uint64)


def word_hashes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(hashes of all words in order, number of words of each text); words are lower-cased."""
    data = [t.lower().encode(errors="replace") + b" " for t in texts]
    ends_at = np.cumsum([len(d) for d in data])
    raw = np.frombuffer(b"".join(data), np.uint8)
    inside = IN_WORD[raw]
    edge = np.diff(inside.astype(np.int8), prepend=np.int8(0))
    starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    running = np.zeros(len(raw) + 1, np.uint64)
    np.cumsum((raw.astype(np.uint64) + np.uint64(1)) * _powers(BASE, len(raw)), out=running[1:])
    h = (running[ends] - running[starts]) * _powers(pow(BASE, -1, 2**64), len(raw) + 1)[starts]
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(32)
    return h, np.diff(np.searchsorted(starts, ends_at), prepend=0)


def padded(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of the words when each text is followed by PAD empty places, and where each text starts."""
    starts = np.concatenate([[0], np.cumsum(counts + PAD)])
    places = np.arange(counts.sum()) + np.repeat(np.arange(len(counts)) * PAD, counts)
    return places, starts


@dataclass
class Classifier:
    """Two embedding tables of 2**bits rows, filters per width, and the logistic layer with its calibration.

    Weights of the last layer stay at 0 or above: words add evidence and never
    take it away, so the text without words has the lowest score of all.
    """

    bits: int = 17
    dim: int = 8
    n_filters: int = 8
    seed: int = 6
    slope: float = 1.0
    shift: float = 0.0
    tables: np.ndarray = field(init=False)
    filters: list = field(init=False)
    bias: list = field(init=False)
    out: np.ndarray = field(init=False)
    rest: float = 0.0

    def __post_init__(self):
        rng = np.random.default_rng(self.seed)
        self.tables = rng.normal(0, 0.02, (2, 1 << self.bits, self.dim)).astype(np.float32)
        self.filters = [rng.normal(0, 0.4, (w, self.dim, self.n_filters)).astype(np.float32) for w in WIDTHS]
        self.bias = [np.zeros(self.n_filters, np.float32) for _ in WIDTHS]
        self.out = np.abs(rng.normal(0, 0.3, len(WIDTHS) * self.n_filters)).astype(np.float32)
        self.rest = -2.0

    def rows(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        mask = np.uint64((1 << self.bits) - 1)
        return (hashes & mask).astype(np.int64), ((hashes >> np.uint64(32)) & mask).astype(np.int64)

    def activations(self, hashes: np.ndarray, counts: np.ndarray):
        """Per width an array (place, filter) of rectified responses, with what training needs besides."""
        places, starts = padded(counts)
        first, second = self.rows(hashes)
        words = np.zeros((starts[-1] + PAD, self.dim), np.float32)
        words[places] = self.tables[0][first] + self.tables[1][second]
        inside = np.zeros(starts[-1], bool)
        inside[places] = True
        out = []
        for filters, bias in zip(self.filters, self.bias, strict=True):
            a = words[: starts[-1]] @ filters[0]
            for k in range(1, len(filters)):
                a += words[k : starts[-1] + k] @ filters[k]
            a += bias
            np.maximum(a, 0, out=a)
            a[~inside] = 0
            out.append(a)
        return out, places, starts, words, (first, second)

    def logits(self, hashes: np.ndarray, counts: np.ndarray) -> np.ndarray:
        acts, _, starts, _, _ = self.activations(hashes, counts)
        pooled = np.hstack([np.maximum.reduceat(a, starts[:-1], axis=0) for a in acts])
        return pooled @ self.out + self.rest

    def scores(self, texts: list[str], block: int = 1 << 20) -> np.ndarray:
        """Calibrated scores; texts are taken in blocks of about so many characters."""
        out, at = [np.zeros(0)], 0
        while at < len(texts):
            end, size = at, 0
            while end < len(texts) and (end == at or size + len(texts[end]) <= block):
                size += len(texts[end])
                end += 1
            out.append(self.logits(*word_hashes(texts[at:end])))
            at = end
        z = np.clip(self.slope * np.concatenate(out).astype(np.float64) + self.shift, -40, 40)
        return 1 / (1 + np.exp(-z))

    def step(self, hashes, counts, target, weight, state: dict, rate: float) -> float:
        """One AdaGrad step on a batch; gradients reach the places that won the pooling only."""
        acts, places, starts, words, (first, second) = self.activations(hashes, counts)
        n, f = len(counts), self.n_filters
        won = [np.array([s + a[s:e].argmax(axis=0) for s, e in zip(starts[:-1], starts[1:], strict=True)]) for a in acts]
        pooled = np.hstack([np.take_along_axis(a, w, axis=0) for a, w in zip(acts, won, strict=True)])
        p = 1 / (1 + np.exp(-np.clip(pooled @ self.out + self.rest, -30, 30)))
        dz = ((p - target) * weight / n).astype(np.float32)
        dpool = dz[:, None] * self.out * (pooled > 0)
        dwords = np.zeros_like(words)
        grads = {"out": pooled.T @ dz, "rest": dz.sum()}
        for j, (filters, at) in enumerate(zip(self.filters, won, strict=True)):
            d = dpool[:, j * f : (j + 1) * f]
            grads[f"bias{j}"] = d.sum(axis=0)
            g = np.empty_like(filters)
            for k in range(len(filters)):
                g[k] = np.einsum("nfd,nf->df", words[at + k], d)
                np.add.at(dwords, at + k, d[:, :, None] * filters[k].T[None])
            grads[f"filters{j}"] = g
        self._update("out", self.out, grads["out"], state, rate)
        np.maximum(self.out, 0, out=self.out)
        for j in range(len(WIDTHS)):
            self._update(f"bias{j}", self.bias[j], grads[f"bias{j}"], state, rate)
            self._update(f"filters{j}", self.filters[j], grads[f"filters{j}"], state, rate)
        state["rest"] = state.get("rest", 1e-8) + float(grads["rest"]) ** 2
        self.rest -= rate * float(grads["rest"]) / state["rest"] ** 0.5
        touched = np.flatnonzero(np.abs(dwords[places]).sum(axis=1))
        for t, rows in enumerate((first, second)):
            unique, where = np.unique(rows[touched], return_inverse=True)
            g = np.zeros((len(unique), self.dim), np.float32)
            np.add.at(g, where, dwords[places[touched]])
            sums = state.setdefault(f"table{t}", np.full((1 << self.bits, self.dim), 1e-8, np.float32))
            sums[unique] += g * g
            self.tables[t][unique] -= rate * g / np.sqrt(sums[unique])
        p = np.clip(p, 1e-7, 1 - 1e-7)
        return float(-(weight * (target * np.log(p) + (1 - target) * np.log(1 - p))).mean())

    def packed(self, state: dict) -> np.ndarray:
        """All weights, and behind them the sums of their squared gradients, in one row of numbers."""
        weights = [*self.tables, *self.filters, *self.bias, self.out, np.array([self.rest])]
        names = [f"table{t}" for t in range(2)] + [f"{k}{j}" for k in ("filters", "bias") for j in range(len(WIDTHS))] + ["out", "rest"]
        sums = [np.broadcast_to(state.get(n, 1e-8), w.shape) for n, w in zip(names, weights, strict=True)]
        return np.concatenate([np.ravel(x) for x in (*weights, *sums)]).astype(np.float32)

    def unpacked(self, row: np.ndarray) -> dict:
        """Takes the weights of a packed row, and gives its sums as a state."""
        weights, at = [*self.tables, *self.filters, *self.bias, self.out], 0
        for w in weights:
            w[...] = row[at : at + w.size].reshape(w.shape)
            at += w.size
        self.rest, at = float(row[at]), at + 1
        state, names = {}, [f"table{t}" for t in range(2)] + [f"{k}{j}" for k in ("filters", "bias") for j in range(len(WIDTHS))] + ["out"]
        for n, w in zip(names, weights, strict=True):
            state[n] = row[at : at + w.size].reshape(w.shape).copy()
            at += w.size
        return state | {"rest": float(row[at])}

    @staticmethod
    def _update(name: str, value: np.ndarray, grad: np.ndarray, state: dict, rate: float) -> None:
        sums = state.setdefault(name, np.full_like(value, 1e-8))
        sums += grad * grad
        value -= rate * grad / np.sqrt(sums)


def best_threshold(z: np.ndarray, y: np.ndarray) -> float:
    """The middle of the widest cut with the highest F1; infinite without positives."""
    if not y.any():
        return float("inf")
    order = np.argsort(-z, kind="stable")
    z, hits = z[order], np.cumsum(y[order])
    f1 = 2 * hits / (np.arange(1, len(z) + 1) + y.sum())
    gaps = np.append(z[:-1] - z[1:], 1.0)
    f1[gaps <= 0] = -1
    top = np.flatnonzero(f1 >= f1.max() - 1e-12)
    k = top[np.argmax(gaps[top])]
    return float(z[k] - gaps[k] / 2)


def train(
    words: list[np.ndarray], toxic: list[int], languages: list[str | None], at_score: float = 0.7, steps: int = 3000, batch: int = 32, seed: int = 6
) -> tuple[Classifier, dict[str, float]]:
    """A classifier and a threshold on its score per language, from the word hashes of labelled texts.

    A fifth of the rows is left out of training. On it the logit with the best
    F1 becomes `at_score`, and each language with both labels there gets the
    threshold best for it; others use `at_score`. With one label only, every
    score is near 0 or near 1.
    """
    model, y = Classifier(seed=seed), np.array(toxic, np.float32)
    if len(y) == 0 or y.min() == y.max():
        model.out[:] = 0
        model.rest = -10.0 if len(y) == 0 or y.max() == 0 else 10.0
        return model, {}
    counts = np.array([len(w) for w in words], np.int64)
    rng = np.random.default_rng(seed)
    order = rng.permutation(len(y))
    held = np.sort(order[: len(y) // 5])
    rows = order[len(y) // 5 :]
    positive = max(y[rows].sum(), 1.0)
    weight = np.where(y > 0, min(10.0, (len(rows) - positive) / positive), 1.0).astype(np.float32) ** 0.5
    gather = lambda some: np.concatenate([words[i] for i in some])
    state: dict = {}
    epochs = max(4, steps * batch // len(rows))
    for epoch in range(epochs):
        rng.shuffle(rows)
        for at in range(0, len(rows), batch):
            some = rows[at : at + batch]
            model.step(gather(some), counts[some], y[some], weight[some], state, 0.05 if epoch < epochs // 2 else 0.02)
    if not (0 < y[held].sum() < len(held)):
        held = np.arange(len(y))  # too few labels to hold any out
    z = np.concatenate([model.logits(gather(c), counts[c]) for c in np.array_split(held, -(-len(held) // 64))]).astype(np.float64)
    model.slope = 1.0
    model.shift = float(np.log(at_score / (1 - at_score)) - best_threshold(z, y[held]))
    scores = 1 / (1 + np.exp(-np.clip(z + model.shift, -40, 40)))
    thresholds = {}
    for language in sorted({x for x in languages if x is not None}):
        mine = np.array([languages[i] == language for i in held])
        if 0 < y[held][mine].sum() < mine.sum():
            thresholds[language] = best_threshold(scores[mine], y[held][mine])
    return model, thresholds


def held_out(key: Column) -> Column:
    """The third of the ids whose labels are never learned from."""
    return F.crc32(key.cast("string").cast("binary")) % 3 == 1


def training_rows(
    docs: DataFrame, labels: DataFrame, label: str, most_rows: int | None = None, most_chars: int | None = None, seed: int = 6
) -> DataFrame:
    """Word hashes of all labelled documents that are not held out.

    An id is one row, however often it stands in either table: it has the
    largest of its labels and the longest of its texts. With bounds, which `toxicity`
    does not set, documents are drawn by a hash of the id, about as many as keep within both.
    """
    learned = lambda key: key.isNotNull() & ~F.coalesce(held_out(key), F.lit(True))
    known = labels.filter(F.col(label).isNotNull() & learned(F.col("doc_id")))
    known = known.groupBy(F.col("doc_id").alias("_labelled")).agg(F.max(label).cast("int").alias("_label"))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"), F.col("lang").cast("string").alias("lang"))
    rows = rows.filter(learned(F.col("doc_id")))  # before the texts are moved
    if most_rows is not None and most_chars is not None:
        lengths = rows.groupBy("doc_id").agg(F.max(F.length("text")).alias("n"))
        n, chars = lengths.join(known, F.col("doc_id") == F.col("_labelled")).agg(F.count("*"), F.sum("n")).first()
        share = min(1.0, most_rows / max(n, 1), most_chars / max(chars or 0, 1))
        draw = F.shiftrightunsigned(F.xxhash64(F.lit(seed), "_labelled"), 11) / F.lit(float(1 << 53))
        known = known.filter(draw < share)
    rows = rows.join(known, F.col("doc_id") == F.col("_labelled"))
    longest = F.max(F.struct(F.length("text").alias("n"), "text", "lang")).alias("best")
    rows = rows.groupBy("doc_id", "_label").agg(longest).select("doc_id", "best.lang", "_label", "best.text")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words = [word_hashes([t.as_py()])[0].tobytes() for t in batch.column(3)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(words, pa.binary())], ["doc_id", "lang", "label", "words"])

    return rows.mapInArrow(run, "doc_id long, lang string, label int, words binary")


#: Weights to a row, when the tasks' models are brought together.
_BLOCK = 4096


def fit(rows: DataFrame, tasks: int, at_score: float, seed: int, rounds: int = 4, passes: int = 2) -> tuple[Classifier, dict[str, float]]:
    """The same as `train`, from a table of training rows that one task can't hold.

    Each round every task goes over its rows from the common weights, and the
    weights take the mean of the tasks' changes; a weight that only some tasks
    changed takes the mean of these, so rare words count in full. What reaches
    the driver is one model a round and a count of scores. A fifth of the
    ids is left out of training and calibrates, on a grid of 1/1024 logits.
    """
    n, positive, negative = rows.agg(F.count("*"), F.count(F.when(F.col("label") > 0, 1)), F.count(F.when(F.col("label") <= 0, 1))).first()
    if not positive or not negative:
        return train([], [], []) if not n else train([np.zeros(0, np.uint64)], [int(positive > 0)], [None])
    weight = float(min(10.0, negative / positive)) ** 0.5
    aside = F.pmod(F.xxhash64(F.lit(seed), "doc_id"), F.lit(5)) == 0
    kept, left_out = rows.filter(~aside).select("doc_id", "label", "words").coalesce(tasks), rows.filter(aside)
    model = Classifier(seed=seed)
    common = model.packed({})
    for number in range(rounds):
        rate, before = 0.05 if number < rounds // 2 else 0.02, common

        def changes(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            mine = Classifier(seed=seed)
            state, rng = mine.unpacked(before), np.random.default_rng(seed + number)  # noqa: B023
            # A task's share of the rows, in the order of their ids, so that a rerun finds the same model.
            held = sorted(((i, y, w) for b in batches for i, y, w in zip(*(c.to_pylist() for c in b.columns), strict=True)), key=lambda r: r[0])
            words = [np.frombuffer(w, np.uint64) for _, _, w in held]
            y, counts = np.array([y for _, y, _ in held], np.float32), np.array([len(w) for w in words], np.int64)
            order = np.arange(len(held))
            for _ in range(passes):
                rng.shuffle(order)
                for at in range(0, len(order), 32):
                    some = order[at : at + 32]
                    each = np.where(y[some] > 0, weight, 1.0).astype(np.float32)
                    mine.step(np.concatenate([words[i] for i in some]), counts[some], y[some], each, state, rate)  # noqa: B023
            change = mine.packed(state) - before  # noqa: B023
            blocks = [b for b in range(-(-len(change) // _BLOCK)) if change[b * _BLOCK : (b + 1) * _BLOCK].any()]
            yield pa.RecordBatch.from_arrays(
                [pa.array(blocks, pa.int32()), pa.array([change[b * _BLOCK : (b + 1) * _BLOCK].tobytes() for b in blocks], pa.binary())], ["block", "change"]
            )

        moved = kept.mapInArrow(changes, "block int, change binary").groupBy("block").applyInArrow(_mean_change, "block int, change binary")
        common = before.copy()
        for b, change in zip(*moved.toArrow().to_pydict().values(), strict=True):
            common[b * _BLOCK : (b + 1) * _BLOCK] += np.frombuffer(change, np.float32)
        np.maximum(common[len(common) // 2 :], 1e-8, out=common[len(common) // 2 :])
    model.unpacked(common)
    found = _score_counts(left_out, model)
    if not (0 < sum(r["hits"] for r in found) < sum(r["n"] for r in found)):
        found = _score_counts(rows, model)  # too few labels to leave any out
    model.shift = float(np.log(at_score / (1 - at_score)) - _best_cut(found))
    thresholds = {}
    for language in sorted({r["lang"] for r in found} - {None}):
        mine = [r for r in found if r["lang"] == language]
        if 0 < sum(r["hits"] for r in mine) < sum(r["n"] for r in mine):
            thresholds[language] = float(1 / (1 + np.exp(-np.clip(_best_cut(mine) + model.shift, -40, 40))))
    return model, thresholds


def _mean_change(rows: pa.Table) -> pa.Table:
    """Of each weight of a block the mean change by the tasks that changed it."""
    changes = np.stack([np.frombuffer(c, np.float32) for c in sorted(rows.column("change").to_pylist())]).astype(np.float64)
    mean = changes.sum(axis=0) / np.maximum((changes != 0).sum(axis=0), 1)
    return pa.table({"block": rows.column("block")[:1], "change": pa.array([mean.astype(np.float32).tobytes()], pa.binary())})


def _score_counts(rows: DataFrame, model: Classifier) -> list[dict]:
    """Rows and toxic rows of each language and logit, in steps of 1/1024."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words = [np.frombuffer(w, np.uint64) for w in batch.column(2).to_pylist()]
            parts = [words[at : at + 64] for at in range(0, len(words), 64)]
            z = [model.logits(np.concatenate(p), np.array([len(w) for w in p], np.int64)) for p in parts]
            step = np.rint(np.clip(np.concatenate([np.zeros(0), *z]), -1000, 1000) * 1024).astype(np.int64)
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(step)], ["lang", "label", "step"])

    scored = rows.select("lang", "label", "words").mapInArrow(run, "lang string, label int, step long")
    counts = scored.groupBy("lang", "step").agg(F.count("*").alias("n"), F.sum((F.col("label") > 0).cast("int")).alias("hits"))
    return counts.toArrow().to_pylist()


def _best_cut(counts: list[dict]) -> float:
    """`best_threshold` over counted logits; there are rows with either label."""
    steps, where = np.unique([-r["step"] for r in counts], return_inverse=True)
    n, hits = (np.bincount(where, weights=[r[c] for r in counts]).cumsum() for c in ("n", "hits"))
    f1 = 2 * hits / (n + hits[-1])
    z = -steps / 1024
    gaps = np.append(z[:-1] - z[1:], 1.0)
    top = np.flatnonzero(f1 >= f1.max() - 1e-12)
    k = top[np.argmax(gaps[top])]
    return float(z[k] - gaps[k] / 2)


def toxicity(
    docs: DataFrame,
    labels: DataFrame,
    label: str = "toxic",
    at_score: float = 0.7,
    task_rows: int = 12_000,
    task_chars: int = 30_000_000,
    seed: int = 6,
    **options,
) -> DataFrame:
    """`doc_id`, `held_out`, `score`, `predicted` and `flagged` of every document.

    The score depends on the text alone. The classifier learns from all labelled
    documents that are not `held_out`: at once where they are no more than `task_rows`
    and `task_chars`, and else in tasks of about so many each (see `fit`).
    `predicted` is 1 from `at_score` up; `flagged` uses the threshold calibrated
    for the document's `lang`, where there is one. A null text counts as empty
    and gets the score of a text without words; a null id is not held out.
    Labels of one id count once. Other columns are not read; an empty table
    gives no rows. Whole texts are scored, a batch at a time.
    """
    spark = docs.sparkSession
    path = scratch_path(spark, "toxicity-training")
    learned = training_rows(docs, labels, label, seed=seed)
    learned.write.option("compression", "zstd").parquet(path)
    learned = spark.read.schema(learned.schema).parquet(path)
    n, words = learned.agg(F.count("*"), F.sum(F.length("words"))).first()
    # A word's hash is eight bytes, about as long as the word and a blank.
    tasks = max(1, -(-n // task_rows), -(-(words or 0) // task_chars))
    if tasks > 1:
        model, thresholds = fit(learned, tasks, at_score, seed)
    else:
        rows = sorted(learned.toArrow().to_pylist(), key=lambda r: (r["doc_id"], r["label"], r["words"]))
        hashes = [np.frombuffer(r["words"], np.uint64) for r in rows]
        model, thresholds = train(hashes, [r["label"] for r in rows], [r["lang"] for r in rows], at_score, seed=seed, **options)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scores = model.scores(batch.column("text").to_pylist())
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("lang"), pa.array(scores, pa.float64())], ["doc_id", "lang", "score"]
            )

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("lang").cast("string").alias("lang"), F.coalesce("text", F.lit("")).alias("text"))
    scored = rows.mapInArrow(run, "doc_id long, lang string, score double")
    threshold = F.lit(at_score)
    for language, value in thresholds.items():
        threshold = F.when(F.col("lang") == language, F.lit(value)).otherwise(threshold)
    return scored.select(
        "doc_id",
        F.coalesce(held_out(F.col("doc_id")), F.lit(False)).alias("held_out"),
        "score",
        (F.col("score") >= at_score).cast("int").alias("predicted"),
        (F.col("score") >= threshold).alias("flagged"),
    )
