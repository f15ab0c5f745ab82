"""Windows of sequences in numpy: hashes of any run, content-chosen anchors, and marked stretches."""

from __future__ import annotations

import numpy as np

#: Odd, so it has an inverse by which a running sum gives the hash of any run.
BASE = 0x9E3779B97F4A7C15
_POWERS: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """base**0 ... base**(n-1) modulo 2**64; kept and grown by doubling."""
    held = _POWERS.get(base)
    if held is None or len(held) < n:
        size = max(n, 2 * len(held) if held is not None else 1 << 16)
        values = np.full(size, base, np.uint64)
        values[0] = 1
        held = _POWERS[base] = np.cumprod(values, dtype=np.uint64)
    return held[:n]


def mixed(h: np.ndarray) -> np.ndarray:
    """The same numbers with all bits spread over all bits."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


class Hashes:
    """Hashes of all runs of a sequence of unsigned 64-bit items, modulo 2**64."""

    def __init__(self, items: np.ndarray):
        self.sums = np.zeros(len(items) + 1, np.uint64)
        np.cumsum((items + np.uint64(1)) * powers(BASE, len(items)), out=self.sums[1:])
        self.inverse = powers(pow(BASE, -1, 2**64), len(items) + 1)

    def of(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        return mixed((self.sums[ends] - self.sums[starts]) * self.inverse[starts])

    def all(self, width: int) -> np.ndarray:
        """The hash of the run of `width` items at each place where it fits."""
        n = len(self.sums) - width
        return mixed((self.sums[width:] - self.sums[:n]) * self.inverse[:n])


def sliding_least(values: np.ndarray, width: int) -> np.ndarray:
    """The least of each `width` values in a row, by doubling."""
    reach = 1
    while 2 * reach <= width:
        values = np.minimum(values[:-reach], values[reach:])
        reach *= 2
    rest = width - reach
    return np.minimum(values[:-rest], values[rest:]) if rest else values


def anchored(hashes: Hashes, lengths: np.ndarray, window: int, gram: int):
    """Groups of neighbouring windows that share an anchor, for sequences laid end to end.

    A window's anchor is the place of the gram with the least hash in it, the
    first of equals, so equal windows have their anchor at the same offset.
    Gives (first window, number of windows, anchor, number of the sequence)
    per group; windows never cross from one sequence into the next.
    """
    starts = np.concatenate([[0], np.cumsum(lengths)])
    places = starts[-1] - window + 1
    if places <= 0:
        return (np.zeros(0, np.int64),) * 4
    grams = hashes.all(gram)
    grams = (grams & np.uint64(0xFFFFFFFF00000000)) | np.arange(len(grams), dtype=np.uint64)
    anchor = (sliding_least(grams, window - gram + 1) & np.uint64(0xFFFFFFFF)).astype(np.int64)
    fits = np.zeros(places, bool)
    for a, b in zip(starts[:-1].tolist(), starts[1:].tolist(), strict=True):
        fits[a : max(a, b - window + 1)] = True
    new = np.empty(places, bool)
    new[0] = True
    new[1:] = (anchor[1:] != anchor[:-1]) | (fits[1:] != fits[:-1])
    # Anchors of windows in different sequences differ, for no valid window leaves its own.
    first = np.flatnonzero(new)
    count = np.diff(np.append(first, places))
    kept = fits[first]
    first, count = first[kept], count[kept]
    return first, count, anchor[first], np.searchsorted(starts, first, side="right") - 1


def covered(n: int, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A mask of `n` places that are inside any of the stretches [start, end)."""
    steps = np.zeros(n + 1, np.int64)
    np.add.at(steps, starts, 1)
    np.add.at(steps, ends, -1)
    return np.cumsum(steps[:-1]) > 0
