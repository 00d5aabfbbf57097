"""Words of Arrow text columns as integers, without a Python object per word."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from .common import mix64

_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BYTE = mix64(np.arange(1, 257, dtype=np.uint64))
_BASE = np.uint64(0xD6E8FEB86659FD93)
_POWERS = np.ones(1, np.uint64)
#: Bytes of words that are hashed at a time.
RUN = 1 << 20


def powers(n: int) -> np.ndarray:
    """base ** 0 .. base ** (n - 1), modulo 2 ** 64."""
    global _POWERS
    if len(_POWERS) < n:
        full = np.full(max(n, 4096), _BASE, np.uint64)
        full[0] = 1
        _POWERS = np.cumprod(full, dtype=np.uint64)
    return _POWERS


def utf8(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all texts end to end, and where each begins (one more entry than texts)."""
    texts = pc.fill_null(texts, "").cast(pa.large_string())
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = texts.buffers()[2]
    raw = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None else np.zeros(0, np.uint8)
    return raw, offsets - offsets[0]


def slices(texts: pa.Array, most: int = 4 << 20):
    """Cut a column into runs of rows of about `most` bytes: (first row, rows)."""
    if not len(texts):
        return
    size = pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    run = np.cumsum(size) // most
    first = np.flatnonzero(np.append(True, run[1:] != run[:-1]))
    for a, b in zip(first, np.append(first[1:], len(size)), strict=True):
        yield int(a), texts.slice(int(a), int(b - a))


def distinct(values: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rising distinct values, where each stands first, and by value its place among them."""
    order = np.argsort(values, kind="stable")
    ranked = values[order]
    new = np.ones(len(ranked), bool)
    new[1:] = ranked[1:] != ranked[:-1]
    kept, first = ranked[new], order[new]
    del ranked
    place = np.empty(len(order), np.int32)
    place[order] = np.cumsum(new, dtype=np.int32) - 1
    return kept, first, place


class Words:
    """All words of a run of texts: `word` (one StringArray), and for each its text and its place in bytes."""

    def __init__(self, texts: pa.Array, lower: bool = False, apart: np.ndarray = _SPACE):
        """apart: by byte, whether it separates words."""
        self.raw, self.text_at = utf8(texts)
        if lower:
            self.raw = _LOWER[self.raw]
        n = len(self.raw)
        kind = np.int32 if n < 1 << 31 else np.int64
        space = np.ones(n + 1, bool)  # by place: whether white space stands there
        space[:-1] = apart[self.raw]
        edge = np.zeros(n + 1, bool)  # a word ends with its text
        edge[self.text_at] = True
        begins = ~space[:-1] & edge[:-1]
        begins[1:] |= ~space[1:-1] & space[:-2]
        self.start = np.flatnonzero(begins).astype(kind)
        del begins
        self.stop = (np.flatnonzero(~space[:-1] & (space[1:] | edge[1:])) + 1).astype(kind)
        del space, edge
        #: number of words in each text, and the first word of each
        self.first = np.searchsorted(self.start, self.text_at)
        self.count = np.diff(self.first)

    def hashes(self) -> np.ndarray:
        """A 64-bit polynomial hash of each word's bytes, the same in every process. Works on RUN bytes of words at a time."""
        size = (self.stop - self.start).astype(np.int64)
        value = np.zeros(len(size), np.uint64)
        ends = np.cumsum(size)
        edge = np.unique(np.append(np.searchsorted(ends, np.arange(0, int(ends[-1]) if len(ends) else 0, RUN)), len(size)))
        for a, b in zip(edge, edge[1:], strict=False):
            own = np.flatnonzero(size[a:b] <= RUN) + a
            if len(own):
                n = size[own]
                at = np.cumsum(n) - n
                inner = np.arange(int(n.sum()), dtype=np.int32) - np.repeat(at.astype(np.int32), n)
                value[own] = np.add.reduceat(_BYTE[self.raw[inner + np.repeat(self.start[own], n)]] * powers(int(n.max()))[inner], at)
        for i in np.flatnonzero(size > RUN):  # one word longer than a run
            part, total = self.raw[self.start[i] : self.stop[i]], 0
            for k in range(0, len(part), RUN):
                own = part[k : k + RUN]
                total += int((_BYTE[own] * powers(RUN)[: len(own)]).sum(dtype=np.uint64)) * pow(int(_BASE), k, 1 << 64)
            value[i] = total % (1 << 64)
        return mix64(value + size.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))

    def prefixes(self, k: int) -> np.ndarray:
        """A hash of the first k bytes of each word longer than that, 0 for the others."""
        out = np.zeros(len(self.start), np.uint64)
        long = np.flatnonzero(self.stop - self.start > k)
        value = np.zeros(len(long), np.uint64)
        for i in range(k):
            value += _BYTE[self.raw[self.start[long] + i]] * powers(k)[i]
        out[long] = mix64(value ^ np.uint64(0xA5A5A5A5 + k))
        return out
