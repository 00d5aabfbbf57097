"""Token ids of whole Arrow columns with the `tokenizers` library.

A byte-level BPE with the usual split pattern never forms a token across the place where white space
follows other text, or where an ASCII letter is followed by another ASCII sign. Texts are cut there, and each
distinct piece goes through the library once for a slice; short pieces already met by this process are kept, as hashes, bytes and ids
in flat arrays, so a worker that stays alive between tasks holds little. A hash that meets is compared byte by byte.
The strings of special tokens count as ordinary text. A null text is empty; a text of any length stands in one slice.
"""

from __future__ import annotations

import os

import numpy as np
import pyarrow as pa

from .common import mix64
from .words import powers, slices, utf8

_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_LETTER = np.zeros(256, bool)
_LETTER[65:91] = _LETTER[97:123] = True
_ASCII = np.arange(256) < 128

#: Distinct pieces that a process keeps (beyond it the store starts anew), and the bytes of the longest that is kept.
KEEP, LONGEST = 500_000, 48
#: Bytes of text that are encoded at a time.
SLICE = 4 << 20


def _wide_space(b: np.ndarray, i: np.ndarray) -> np.ndarray:
    """Whether the character that ends at byte i - 1 is white space outside ASCII."""
    p1, p2, p3 = b[i - 1], b[np.maximum(i - 2, 0)], b[np.maximum(i - 3, 0)]
    two = (p2 == 0xC2) & ((p1 == 0x85) | (p1 == 0xA0))
    e280 = (p3 == 0xE2) & (p2 == 0x80) & ((p1 <= 0x8A) | (p1 == 0xA8) | (p1 == 0xA9) | (p1 == 0xAF))
    rest = ((p3 == 0xE1) & (p2 == 0x9A) & (p1 == 0x80)) | ((p3 == 0xE2) & (p2 == 0x81) & (p1 == 0x9F)) | ((p3 == 0xE3) & (p2 == 0x80) & (p1 == 0x80))
    return two | e280 | rest


def _inner(size: np.ndarray) -> np.ndarray:
    """0, 1, .. size - 1 of each, end to end."""
    return np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size)


def _hashes(raw: np.ndarray, at: np.ndarray, size: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each non-empty piece."""
    if not len(size):
        return np.zeros(0, np.uint64)
    inner = _inner(size)
    value = powers(LONGEST)[inner] * (raw[inner + np.repeat(at, size)].astype(np.uint64) + np.uint64(1))
    return mix64(np.add.reduceat(value, np.cumsum(size) - size) + size.astype(np.uint64))


class Encoder:
    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.lib = Tokenizer.from_file(path)
        self.lib.encode_special_tokens = True
        self.lib.model._resize_cache(0)  # pieces are kept here instead
        vocab = self.lib.get_vocab(with_added_tokens=True)
        self.size = max(vocab.values()) + 1
        self.bytes = np.ones(self.size, np.int64)
        for token, i in vocab.items():
            self.bytes[i] = len(token)  # one character for each byte
        self.dtype = np.uint16 if self.size <= 1 << 16 else np.uint32
        self.clear()

    def clear(self) -> None:
        #: hashes of the pieces kept, rising, and the slot of each
        self.hash, self.slot = np.zeros(0, np.uint64), np.zeros(0, np.int32)
        #: by slot: where its ids and its bytes begin (one more entry than slots)
        self.ids_at, self.bytes_at = np.zeros(1, np.int64), np.zeros(1, np.int64)
        self.ids, self.raw = np.zeros(0, self.dtype), np.zeros(0, np.uint8)

    def _find(self, raw: np.ndarray, at: np.ndarray, size: np.ndarray, value: np.ndarray) -> np.ndarray:
        """The slot of each piece, or -1."""
        out = np.full(len(value), -1, np.int64)
        if not len(self.hash) or not len(value):
            return out
        spot = np.minimum(np.searchsorted(self.hash, value), len(self.hash) - 1)
        maybe = np.flatnonzero(self.hash[spot] == value)
        slot = self.slot[spot[maybe]].astype(np.int64)
        same = np.diff(self.bytes_at)[slot] == size[maybe]
        maybe, slot = maybe[same], slot[same]
        if len(maybe):
            n = size[maybe]
            inner = _inner(n)
            equal = raw[inner + np.repeat(at[maybe], n)] == self.raw[inner + np.repeat(self.bytes_at[slot], n)]
            good = np.logical_and.reduceat(equal, np.cumsum(n) - n)
            out[maybe[good]] = slot[good]
        return out

    def _learn(self, new: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids of new pieces, how many each has, and the order they are in; those that stay apart when written one after another go in long runs."""
        raw, at = utf8(new)
        head, tail = raw[at[:-1]], raw[at[1:] - 1]
        # pieces that end outside ASCII may end in white space, so they go alone
        runs = _SPACE[head] & _ASCII[tail] & ~_SPACE[tail] & ~((tail >= 28) & (tail <= 31))
        ids, sizes, order, single = [], [], [], list(np.array_split(np.flatnonzero(~runs), np.arange(500, int((~runs).sum()), 500)))
        apart = np.flatnonzero(runs)
        raw, at = utf8(new.take(pa.array(apart)))
        for i in range(0, len(apart), 500):
            group, ends = apart[i : i + 500], at[i + 1 : i + 501] - at[i]
            text = raw[at[i] : at[i] + ends[-1]].tobytes().decode()
            own = np.array(self.lib.encode_batch_fast([text], add_special_tokens=False)[0].ids, self.dtype)
            stop = np.cumsum(self.bytes[own])
            cut = np.searchsorted(stop, ends)
            if cut[-1] >= len(stop) or not np.array_equal(stop[cut], ends):
                single.append(group)
                continue
            ids.append(own)
            sizes.append(np.diff(cut, prepend=-1))
            order.append(group)
        for group in single:
            if len(group):
                for x in self.lib.encode_batch_fast(new.take(pa.array(group)).to_pylist(), add_special_tokens=False):
                    ids.append(np.array(x.ids, self.dtype))
                    sizes.append(np.array([len(ids[-1])]))
                order.append(group)
        return np.concatenate(ids), np.concatenate(sizes).astype(np.int64), np.concatenate(order)

    def encode(self, texts: pa.Array, end: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts end to end, and where each text begins (one more entry than texts)."""
        b, at = utf8(texts)
        n = len(at) - 1
        space, letter = _SPACE[b], _LETTER[b]
        cut = np.zeros(len(b), bool)
        after = space[1:] & ~space[:-1]
        wide = np.flatnonzero(after & ~_ASCII[b[:-1]]) + 1
        cut[1:] = after | (_ASCII[b[1:]] & ~letter[1:] & letter[:-1])
        if len(wide):
            cut[wide[_wide_space(b, wide)]] = False
        cut[at[:-1][at[:-1] < len(b)]] = True
        start = np.flatnonzero(cut)
        pieces = pa.LargeStringArray.from_buffers(len(start), pa.py_buffer(np.append(start, len(b)).astype(np.int64)), pa.py_buffer(np.ascontiguousarray(b)))
        d = pieces.dictionary_encode()
        if len(self.ids_at) > KEEP:
            self.clear()
        known, forget = self._known(d.dictionary)
        code = d.indices.to_numpy(zero_copy_only=False)
        size = np.diff(self.ids_at).astype(np.int32)[known][code]
        owner = np.repeat(np.arange(n, dtype=np.int32), np.diff(np.searchsorted(start, at)))
        own = np.bincount(owner, size, n).astype(np.int64)
        extra = 0 if end is None else 1
        out_at = np.concatenate(([0], np.cumsum(own + extra)))
        out = np.empty(out_at[-1], self.dtype)
        if len(size):
            step = np.arange(int(size.sum()), dtype=np.int64)
            inner = np.cumsum(size, dtype=np.int64) - size
            found = self.ids[step + np.repeat(self.ids_at[known][code] - inner, size)]
            out[step + np.repeat(owner, size) if extra else step] = found
        if extra:
            out[out_at[1:] - 1] = end
        if forget:  # long pieces stand at the end
            self.ids_at, self.bytes_at = self.ids_at[:-forget], self.bytes_at[:-forget]
            self.ids, self.raw = self.ids[: self.ids_at[-1]], self.raw[: self.bytes_at[-1]]
        return out, out_at

    def _known(self, names: pa.Array) -> tuple[np.ndarray, int]:
        """The slot of each piece, new ones included, and how many of the last slots are for this call only."""
        raw, at = utf8(names)
        size = np.diff(at)
        short = np.flatnonzero(size <= LONGEST)
        value = _hashes(raw, at[:-1][short], size[short])
        known = np.full(len(size), -1, np.int64)
        known[short] = self._find(raw, at[:-1][short], size[short], value)
        missing = np.flatnonzero(known < 0)
        if not len(missing):
            return known, 0
        ids, n_ids, order = self._learn(names.take(pa.array(missing)))
        # those to keep come first; two pieces of one hash are both new here only if they differ, and one of them stays
        by = np.full(len(size), np.uint64(0))
        by[short] = value
        new = missing[order]
        keep = size[new] <= LONGEST
        first = np.zeros(len(new), bool)
        first[np.unique(by[new], return_index=True)[1]] = True
        keep &= first
        if len(self.hash):
            keep &= self.hash[np.minimum(np.searchsorted(self.hash, by[new]), len(self.hash) - 1)] != by[new]
        turn = np.argsort(~keep, kind="stable")
        begin = np.cumsum(n_ids) - n_ids
        ids = ids[_inner(n_ids[turn]) + np.repeat(begin[turn], n_ids[turn])]
        new, n_ids, kept = new[turn], n_ids[turn], int(keep.sum())
        slots = len(self.ids_at) - 1 + np.arange(len(new))
        known[new] = slots
        n = size[new] * (np.arange(len(new)) < kept)
        self.ids, self.ids_at = np.concatenate((self.ids, ids)), np.concatenate((self.ids_at, self.ids_at[-1] + np.cumsum(n_ids)))
        self.raw, self.bytes_at = np.concatenate((self.raw, raw[_inner(n) + np.repeat(at[new], n)])), np.concatenate((self.bytes_at, self.bytes_at[-1] + np.cumsum(n)))
        hash_, slot = np.concatenate((self.hash, by[new[:kept]])), np.concatenate((self.slot, slots[:kept].astype(np.int32)))
        rising = np.argsort(hash_, kind="stable")
        self.hash, self.slot = hash_[rising], slot[rising]
        return known, len(new) - kept


_OWN: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """One for each process."""
    if path not in _OWN:
        _OWN[path] = Encoder(path)
    return _OWN[path]


def _runs(raw: np.ndarray):
    """(from, to) of runs of about SLICE bytes of a long text that begin where pieces do."""
    a = 0
    while len(raw) - a > SLICE:
        b, found = a + SLICE, False
        while b < len(raw) and not found:
            part = raw[b - 1 : b + (1 << 16)]
            hit = np.flatnonzero(_SPACE[part[1:]] & _ASCII[part[:-1]] & ~_SPACE[part[:-1]])
            found = len(hit) > 0
            b += int(hit[0]) if found else 1 << 16
        if not found:
            break
        yield a, b
        a = b
    yield a, len(raw)


def encoded(path: str, texts: pa.Array, end: int | None):
    """(first row, ids, begins) for runs of rows of a column. A longer text than a run of rows is encoded in parts."""
    own = encoder(path)
    for first, part in slices(texts, SLICE):
        if len(part) == 1 and part.nbytes > 2 * SLICE:
            raw, _ = utf8(part)
            ids = []
            for a, b in _runs(raw):
                one = pa.LargeStringArray.from_buffers(1, pa.py_buffer(np.array([0, b - a], np.int64)), pa.py_buffer(np.ascontiguousarray(raw[a:b])))
                ids.append(own.encode(one)[0])
            ids += [] if end is None else [np.array([end], own.dtype)]
            all_ = np.concatenate(ids)
            yield first, all_, np.array([0, len(all_)])
        else:
            yield first, *own.encode(part, end)
    pa.default_memory_pool().release_unused()
