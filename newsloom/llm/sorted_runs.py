"""Sorted runs of byte strings: front coding, and a loser tree that never compares a known prefix again."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa


def pack(values: np.ndarray) -> bytes:
    """Integers as byte planes, compressed; small values cost little whatever their type."""
    planes = np.ascontiguousarray(values.astype("<i8").view(np.uint8).reshape(-1, 8).T).tobytes()
    return len(planes).to_bytes(8, "little") + pa.compress(planes, codec="zstd", asbytes=True)


def unpack(data: bytes) -> np.ndarray:
    size = int.from_bytes(data[:8], "little")
    planes = np.frombuffer(pa.decompress(data[8:], size, codec="zstd", asbytes=True), np.uint8)
    return np.ascontiguousarray(planes.reshape(8, -1).T).view("<i8").ravel() if size else np.zeros(0, np.int64)


def common(a: bytes, b: bytes, known: int) -> int:
    """Length of the common prefix, of which `known` bytes are sure."""
    n = min(len(a), len(b))
    x, y = a[known:n], b[known:n]
    if x == y:
        return n
    differing = int.from_bytes(x, "big") ^ int.from_bytes(y, "big")
    return n - (differing.bit_length() + 7) // 8


def front_coded(keys: list[bytes]) -> bytes:
    """Ascending keys: per key how much of the one before it stays, and the bytes that follow."""
    shared = [common(a, b, 0) for a, b in zip([b"", *keys], keys, strict=False)]
    tails = [k[s:] for k, s in zip(keys, shared, strict=True)]
    heads = [pack(np.array(shared, np.int64)), pack(np.array([len(t) for t in tails], np.int64))]
    body = b"".join(tails)
    sizes = b"".join(len(h).to_bytes(8, "little") for h in heads) + len(body).to_bytes(8, "little")
    return sizes + heads[0] + heads[1] + pa.compress(body, codec="zstd", asbytes=True)


def decoded(data: bytes) -> Iterator[tuple[bytes, int]]:
    """(key, bytes shared with the key before) in order; one key at a time is put together."""
    a, b, size = (int.from_bytes(data[i : i + 8], "little") for i in (0, 8, 16))
    shared, lengths = unpack(data[24 : 24 + a]).tolist(), unpack(data[24 + a : 24 + a + b]).tolist()
    body = pa.decompress(data[24 + a + b :], size, codec="zstd", asbytes=True) if size else b""
    key, at = b"", 0
    for s, n in zip(shared, lengths, strict=True):
        key = key[:s] + body[at : at + n]
        at += n
        yield key, s


class LoserTree:
    """Merges ascending runs.

    Each run's head has a known common prefix with the key given out last.
    Of two heads the one with the longer prefix is the smaller; only for equal
    ones are bytes compared, from there on, and the loser keeps what was found.
    """

    def __init__(self, runs: list[Iterator[tuple[bytes, int]]]):
        self.runs = runs
        self.n = max(1, 1 << (len(runs) - 1).bit_length()) if runs else 1
        self.keys: list[bytes | None] = [None] * self.n
        self.shared = [0] * self.n
        self.losers = [-1] * self.n
        for i, run in enumerate(runs):
            self.keys[i] = next(run, (None, 0))[0]
        winners = list(range(self.n))
        base = self.n
        while base > 1:
            base //= 2
            for j in range(base):
                win, lose = self._play(winners[2 * j], winners[2 * j + 1])
                self.losers[base + j] = lose
                winners[j] = win
        self.winner = winners[0]

    def _play(self, a: int, b: int) -> tuple[int, int]:
        x, y = self.keys[a], self.keys[b]
        if x is None or y is None:
            return (b, a) if x is None else (a, b)
        p, q = self.shared[a], self.shared[b]
        if p != q:
            return (a, b) if p > q else (b, a)
        h = common(x, y, p)
        if h == len(x) or (h < len(y) and x[h] < y[h]):
            self.shared[b] = h
            return a, b
        self.shared[a] = h
        return b, a

    def __iter__(self) -> Iterator[tuple[int, bytes, int]]:
        """(run, key, bytes shared with the key before) in ascending order of keys."""
        keys, shared, losers, runs, n = self.keys, self.shared, self.losers, self.runs, self.n
        win = self.winner
        while (key := keys[win]) is not None:
            run = win
            yield run, key, shared[run]
            key, known = next(runs[run], (None, 0))
            keys[run], shared[run] = key, known
            # Up to the root, as in `_play`: the winner so far is `win` with `key` and `known`.
            at = (n + run) >> 1
            while at:
                other = losers[at]
                if (rival := keys[other]) is not None:
                    theirs = shared[other]
                    if key is None or theirs > known:
                        losers[at], win, key, known = win, other, rival, theirs
                    elif theirs == known:
                        h = common(key, rival, known)
                        if h == len(key) or (h < len(rival) and key[h] < rival[h]):
                            shared[other] = h
                        else:
                            shared[win] = h
                            losers[at], win, key, known = win, other, rival, theirs
                at >>= 1
        self.winner = win
