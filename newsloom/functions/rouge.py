"""ROUGE-1 and ROUGE-L of summary texts against reference texts."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from newsloom.functions.scoring import metric
from newsloom.functions.stemming import porter_stem
from newsloom.functions.text import let, text_or_empty
from newsloom.schema import ROUGE

NOT_TOKEN = "[^a-z0-9]+"

_SPLIT = re.compile(NOT_TOKEN)


def tokens(text: Column) -> Column:
    """Lower-case runs of a-z and 0-9; every other character separates."""
    return F.filter(F.split(F.lower(text), NOT_TOKEN), lambda t: F.length(t) > 0)


def token_list(text: str | None, stem: Callable[[str], str] | None) -> list[str]:
    """Tokens of a text; `stem` is applied to those of more than three characters."""
    found = [t for t in _SPLIT.split((text or "").lower()) if t]
    return [stem(t) if len(t) > 3 else t for t in found] if stem else found


def stemmer(wanted: bool) -> Callable[[str], str] | None:
    """A stemmer with a memory of its own, made inside a task."""
    return lru_cache(maxsize=100_000)(porter_stem) if wanted else None


def common_length(left: list[str], right: list[str]) -> int:
    """Length of the longest common subsequence, a row of the table per integer."""
    masks: dict[str, int] = {}
    for i, token in enumerate(left):
        masks[token] = masks.get(token, 0) | (1 << i)
    full = (1 << len(left)) - 1
    row = full
    for token in right:
        hit = row & masks.get(token, 0)
        row = ((row + hit) | (row - hit)) & full
    return len(left) - row.bit_count()


#: Cells of the tables that one step of `common_lengths` holds.
_CELLS = 1 << 21


def common_lengths(lefts: list[list[str]], rights: list[list[str]]) -> list[int]:
    """Length of the longest common subsequence of each pair, for all pairs at once.

    Common heads and tails are taken off first. What is left goes through the
    table of the subsequence row by row, 64 columns to a word, one row of all
    pairs of a similar size in a step.
    """
    out, rest = [], []
    for i, (a, b) in enumerate(zip(lefts, rights, strict=True)):
        a, b = (a, b) if len(a) >= len(b) else (b, a)
        head, n = 0, len(b)
        while head < n and a[head] == b[head]:
            head += 1
        tail = 0
        while tail < n - head and a[-1 - tail] == b[-1 - tail]:
            tail += 1
        out.append(head + tail)
        if head + tail < n:
            rest.append((-(-(len(a) - head - tail) // 64), n - head - tail, i, a[head : len(a) - tail], b[head : n - tail]))
    rest.sort(key=lambda r: r[:3])
    at = 0
    while at < len(rest):
        end = at + 1
        while end < len(rest) and (end - at + 1) * (rest[end][1] + 64 * rest[end][0]) * rest[end][0] <= _CELLS:
            end += 1
        for (_, _, i, _, _), n in zip(rest[at:end], _table([r[3] for r in rest[at:end]], [r[4] for r in rest[at:end]]), strict=True):
            out[i] += n
        at = end
    return out


def _table(lefts: list[list[str]], rights: list[list[str]]) -> list[int]:
    """`common_lengths` of pairs that are not empty, word by word."""
    code: dict[str, int] = {}
    flat = lambda lists: np.array([code.setdefault(t, len(code)) for x in lists for t in x], np.int64)
    n_left, n_right = (np.array([len(x) for x in lists]) for lists in (lefts, rights))
    left, right = flat(lefts), flat(rights)
    pairs, words = len(lefts), -(-int(n_left.max()) // 64)
    place = lambda n: np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    column = place(n_left)
    # Where each token of a pair's left side stands, as bits; the last row is of tokens that stand nowhere.
    kinds, kind = np.unique(np.repeat(np.arange(pairs), n_left) * len(code) + left, return_inverse=True)
    stands = np.zeros((len(kinds) + 1, words), np.uint64)
    np.bitwise_or.at(stands, (kind, column >> 6), np.uint64(1) << (column & 63).astype(np.uint64))
    asked = np.repeat(np.arange(pairs), n_right) * len(code) + right
    found = np.minimum(np.searchsorted(kinds, asked), len(kinds) - 1)
    order = np.argsort(-n_right, kind="stable")
    rank = np.empty(pairs, np.int64)
    rank[order] = np.arange(pairs)
    steps = np.full((int(n_right.max()), pairs), len(kinds), np.int64)
    steps[place(n_right), np.repeat(rank, n_right)] = np.where(kinds[found] == asked, found, len(kinds))
    size = n_left[order]
    inside = np.arange(words)[None, :] * 64
    used = np.clip(size[:, None] - inside, 0, 64)
    full = np.where(used == 64, np.uint64(2**64 - 1), (np.uint64(1) << (used % 64).astype(np.uint64)) - np.uint64(1))
    row = full.copy()
    open_pairs = np.searchsorted(-n_right[order], -np.arange(len(steps)), side="left")
    for step, n in zip(steps, open_pairs.tolist(), strict=True):
        hit = row[:n] & stands[step[:n]]
        stay = row[:n] & ~hit
        carry = np.zeros(n, np.uint64)
        for w in range(words):
            part = row[:n, w] + hit[:, w]
            more = part < hit[:, w]
            part += carry
            more |= part < carry
            row[:n, w] = part | stay[:, w]
            carry = more.astype(np.uint64)
    lengths = size - np.bitwise_count(row & full).sum(axis=1, dtype=np.int64)
    return lengths[rank].tolist()


def _metric(overlap: int, reference: int, summary: int) -> dict[str, float]:
    precision, recall = overlap / max(summary, 1), overlap / max(reference, 1)
    both = precision + recall
    return {
        "precision": precision,
        "recall": recall,
        "fmeasure": 2 * precision * recall / both if both > 0 else 0.0,
    }


def pair_counts(references: list, summaries: list, stem: bool) -> list[tuple[int, int, int, int]]:
    """(tokens of the reference, of the summary, shared tokens, common subsequence) of each pair."""
    cut = stemmer(stem)
    refs, hyps = ([token_list(t, cut) for t in texts] for texts in (references, summaries))
    shared = [(Counter(a) & Counter(b)).total() for a, b in zip(refs, hyps, strict=True)]
    return list(zip(map(len, refs), map(len, hyps), shared, common_lengths(refs, hyps), strict=True))


def pair_scores(reference: str | None, summary: str | None, stem=None) -> dict:
    ref, hyp = token_list(reference, stem), token_list(summary, stem)
    overlap = (Counter(ref) & Counter(hyp)).total()
    return {
        "rouge1": _metric(overlap, len(ref), len(hyp)),
        "rougeL": _metric(common_length(ref, hyp), len(ref), len(hyp)),
    }


def rouge_score(reference: Column, summary: Column, stem: bool = True) -> Column:
    """Both metrics for a pair of texts, Arrow batches in and out."""

    @F.pandas_udf(ROUGE)
    def score(refs: pd.Series, hyps: pd.Series) -> pd.DataFrame:
        counts = pair_counts(list(refs), list(hyps), stem)
        rows = [{"rouge1": _metric(o, r, h), "rougeL": _metric(c, r, h)} for r, h, o, c in counts]
        return pd.DataFrame(rows, columns=["rouge1", "rougeL"])

    return score(reference, summary)


def bag_overlap(left: Column, right: Column) -> Column:
    """Number of tokens that two lists share, repeats counted, as a column expression.

    The k-th of equal tokens becomes a token of its own, so the bags are sets.
    """

    def numbered(tokens: Column) -> Column:
        return let(
            F.array_sort(tokens),
            lambda s: F.transform(s, lambda t, i: F.concat(t, F.lit("#"), (i + 1 - F.array_position(s, t)).cast("string"))),
        )

    return F.size(F.array_intersect(numbered(left), numbered(right)))


def known_counts(references: Column, summaries: Column, stem: bool) -> Column:
    """What is known of each pair without the subsequence table: `n_ref`, `n_sum`, `overlap`, `common`.

    Where the tokens of one text stand in a row in the other, both counts are
    the size of the shorter, stems or not. That holds for every summary taken out of
    its text. Else `common` is NULL, and with stems `overlap` too. NULL for a missing array.
    """

    def of_tokens(t: Column) -> Column:
        ref, hyp = t["r"], t["h"]
        shorter = F.least(F.size(ref), F.size(hyp))

        def inside(a: Column, b: Column) -> Column:
            padded = lambda x: F.concat(F.lit(" "), F.array_join(x, " "), F.lit(" "))
            return F.contains(padded(a), padded(b))

        settled = (shorter == 0) | inside(ref, hyp) | inside(hyp, ref)
        other = F.lit(None).cast("int") if stem else bag_overlap(ref, hyp)
        return F.struct(
            F.size(ref).alias("n_ref"),
            F.size(hyp).alias("n_sum"),
            F.when(settled, shorter).otherwise(other).alias("overlap"),
            F.when(settled, shorter).alias("common"),
        )

    def of_pair(x: Column) -> Column:
        both = F.struct(tokens(text_or_empty(x["r"])).alias("r"), tokens(text_or_empty(x["h"])).alias("h"))
        return let(both, of_tokens)

    return F.transform(_zipped(references, summaries), of_pair)


def _zipped(references: Column, summaries: Column) -> Column:
    """Pairs of two arrays, as many as the shorter has."""
    pairs = F.arrays_zip(references.alias("r"), summaries.alias("h"))
    return F.slice(pairs, 1, F.least(F.size(references), F.size(summaries)))


def open_counts(references: Column, summaries: Column, known: Column, stem: bool) -> Column:
    """`overlap` and `common` of the pairs that `known_counts` leaves open, NULL for the others.

    Arrow batches; all open pairs of a batch go through the table together.
    """
    kind = T.StructType([T.StructField(n, T.IntegerType()) for n in ("overlap", "common")])

    @F.pandas_udf(T.ArrayType(kind))
    def counted(refs: pd.Series, hyps: pd.Series) -> pd.Series:
        pairs = [(i, j) for i, r in enumerate(refs) if r is not None for j, text in enumerate(r) if text is not None]
        found = pair_counts([refs.iloc[i][j] for i, j in pairs], [hyps.iloc[i][j] for i, j in pairs], stem)
        out = [None if r is None else [None] * len(r) for r in refs]
        for (i, j), (_, _, overlap, common) in zip(pairs, found, strict=True):
            out[i][j] = {"overlap": overlap, "common": common}
        return pd.Series(out)

    def only_open(field: str) -> Column:
        return F.transform(
            F.arrays_zip(_zipped(references, summaries).alias("t"), known.alias("k")),
            lambda x: F.when(x["k"]["common"].isNull(), text_or_empty(x["t"][field])),
        )

    return counted(only_open("r"), only_open("h"))


def scores_of(counts: Column, settled: Column | None, metrics: tuple[str, ...]) -> Column:
    """Scores by metric from the known counts and those of the open pairs."""
    fields = {"rouge1": "overlap", "rougeL": "common"}

    def of_pair(k: Column, s: Column | None) -> Column:
        value = lambda f: k[f] if s is None else F.coalesce(k[f], s[f])
        return F.struct(*[metric(value(fields[m]), k["n_ref"], k["n_sum"]).alias(m) for m in metrics])

    if settled is None:
        return F.transform(counts, lambda k: of_pair(k, None))
    return F.transform(F.arrays_zip(counts.alias("k"), settled.alias("s")), lambda x: of_pair(x["k"], x["s"]))


def mean_metric(scores: Column, name: str, field: str) -> Column:
    """Mean of one field over an array of scores."""
    total = F.aggregate(scores, F.lit(0.0), lambda s, x: s + x[name][field])
    return F.when(F.size(scores) > 0, total / F.size(scores))
