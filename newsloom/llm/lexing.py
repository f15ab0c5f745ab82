"""Words of many texts at once in numpy, as places in one buffer."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

BLANK, WORD, BREAK = 0, 1, 2


def byte_classes(blanks: bytes, breaks: bytes = b"") -> np.ndarray:
    """The class of each byte: between words, of a word, or between pieces whose words do not meet."""
    classes = np.full(256, WORD, np.uint8)
    classes[list(blanks)] = BLANK
    classes[list(breaks)] = BREAK
    return classes


def utf8(texts: pa.Array) -> list[bytes]:
    """Texts as bytes; null is empty."""
    return [t or b"" for t in texts.cast(pa.binary()).to_pylist()]


class Words:
    """The words of texts, in order, A-Z lower-cased where asked.

    `start` and `end` are places in `data`, `text` the number of each word's
    text, `joined` whether the next word follows in the same piece of the same text.
    """

    def __init__(self, texts: list[bytes], classes: np.ndarray, lower: bool = True):
        # A zero byte between texts is a break here, whatever it is inside of texts.
        lengths = np.array([len(t) for t in texts], np.int64)
        self.data = b"\0".join(texts)
        if lower:
            self.data = self.data.lower()
        raw = np.frombuffer(self.data, np.uint8)
        kinds = classes[raw]
        offsets = np.cumsum(lengths + 1)
        kinds[offsets[:-1] - 1] = BREAK
        mask = np.zeros(len(raw) + 2, bool)
        mask[1:-1] = kinds == WORD
        edges = np.flatnonzero(mask[1:] != mask[:-1])
        self.start, self.end = edges[::2], edges[1::2]
        self.text = np.searchsorted(offsets, self.start, side="right")
        breaks = np.flatnonzero(kinds == BREAK)
        piece = np.searchsorted(breaks, self.start)
        self.joined = np.zeros(len(self.start), bool)
        self.joined[:-1] = piece[1:] == piece[:-1]
        self._letters = raw[mask[1:-1]]

    def __len__(self) -> int:
        return len(self.start)

    def encoded(self) -> tuple[np.ndarray, pa.Array]:
        """The code of each word, and the distinct words by code."""
        offsets = np.zeros(len(self) + 1, np.int64)
        np.cumsum(self.end - self.start, out=offsets[1:])
        buffers = [None, pa.py_buffer(offsets), pa.py_buffer(self._letters)]
        found = pa.Array.from_buffers(pa.large_binary(), len(self), buffers).dictionary_encode()
        return found.indices.to_numpy().astype(np.int64), found.dictionary

    def joined_by_blank(self, first: int, n: int) -> bytes:
        """`n` words from the one numbered `first`."""
        spans = zip(self.start[first : first + n].tolist(), self.end[first : first + n].tolist(), strict=True)
        return b" ".join([self.data[a:b] for a, b in spans])


def stable_order(codes: np.ndarray) -> np.ndarray:
    """The stable order of numbers from 0 below 2**32, by their low and then their high half."""
    order = np.argsort((codes & 0xFFFF).astype(np.uint16), kind="stable")
    high = (codes >> 16).astype(np.uint16)
    return order[np.argsort(high[order], kind="stable")] if high.any() else order
