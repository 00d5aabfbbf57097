"""Substring deduplication: Rabin-Karp hashes of every window of `window` words, counted over the corpus.

A window is removed where its words also stand in a document with a smaller id; windows that overlap or touch merge into
maximal intervals. Word hashes x[j] give prefix sums S of x[j] * B**j modulo 2**64, so that the hash of a window at i is
(S[i + window] - S[i]) * B**-i: every window of every document is hashed at the cost of two sums.
Every block of documents sends each of its distinct hashes, with the smallest id that has it, up a tree of bounded fan-out (`exchange`),
and learns which of them have a smaller id elsewhere. Two different windows share a 64-bit hash with a probability of 2**-64.

Defined results: a null text has no words; ids that are equal do not remove each other's words; a null id sorts after all
others; documents shorter than the window stay as they are; an empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import mix64
from .exchange import ASK, BLOCK_BYTES, FAN, RANGE_KEYS, Later, Tree, blocks
from .words import Words, distinct

BASE = 0x9E6C63D0876A9A47
INVERSE = pow(BASE, -1, 1 << 64)
LAST = np.iinfo(np.int64).max
#: Windows that are hashed at a time.
RUN = 1 << 18


def _powers(base: int, n: int) -> np.ndarray:
    full = np.full(n, base, np.uint64)
    full[:1] = 1
    return np.cumprod(full, dtype=np.uint64)


def rolled(x: np.ndarray, window: int) -> np.ndarray:
    """The hash of the window at each place, also across documents (those are not used), made for RUN places at a time."""
    n = max(len(x) - window + 1, 0)
    out = np.empty(n, np.uint64)
    size = min(RUN, n)
    up, down = _powers(BASE, size + window - 1), _powers(INVERSE, size)
    total = np.zeros(len(up) + 1, np.uint64)
    for a in range(0, n, RUN):
        b = min(a + RUN, n)
        own = x[a : b + window - 1]
        np.cumsum(own * up[: len(own)], out=total[1 : len(own) + 1], dtype=np.uint64)
        out[a:b] = mix64((total[window : window + b - a] - total[: b - a]) * down[: b - a])
    return out


class Windows:
    """The windows of one block, with its documents in order of id."""

    def __init__(self, table: pa.Table, window: int):
        ids = table.column("id").combine_chunks().fill_null(LAST).to_numpy(zero_copy_only=False)
        texts = table.column("text").combine_chunks()
        order = np.lexsort((np.arange(len(ids)), ids))
        self.raw_ids = table.column("id").combine_chunks().take(pa.array(order))
        self.ids = ids[order]
        self.words = Words(texts.take(pa.array(order)))
        self.window = window
        room = np.maximum(self.words.count - window + 1, 0)
        kind = self.words.start.dtype
        #: the first word of each window, and its document
        self.start = (np.repeat((self.words.first[:-1] - (np.cumsum(room) - room)).astype(kind), room) + np.arange(int(room.sum()), dtype=kind)).astype(kind)
        self.doc = np.repeat(np.arange(len(ids), dtype=np.int32), room)
        # the first window with a hash is one of the smallest id, as documents are in order
        self.keys, first, self.key = distinct(rolled(self.words.hashes(), window)[self.start])
        self.key_doc = self.doc[first]

    def tracks(self) -> list[tuple[np.ndarray, np.ndarray]]:
        """The distinct hashes with the smallest id of each."""
        return [(self.keys, self.ids[self.key_doc])]

    def flagged(self, elsewhere: np.ndarray) -> np.ndarray:
        """Windows to remove; elsewhere: by key, whether a smaller id in another block has it."""
        return elsewhere[self.key] | (self.ids[self.doc] > self.ids[self.key_doc[self.key]])

    def covered(self, flags: np.ndarray) -> np.ndarray:
        """By word, whether a flagged window covers it."""
        step = np.zeros(len(self.words.start) + 1, np.int8)
        at = self.start[flags]  # each place once
        step[at] += 1
        step[at + self.window] -= 1
        return np.cumsum(step[:-1], dtype=np.int32) > 0


def _kept(words: Words, keep: np.ndarray, doc: np.ndarray, n: int) -> pa.Array:
    """The kept words of each document with one space between them."""
    own = doc[keep]
    last = np.ones(len(keep), bool)
    last[:-1] = own[1:] != own[:-1]
    start, stop = words.start[keep], words.stop[keep]
    # a word that is not its document's last has a byte of white space after it, which becomes the space
    raw = np.append(words.raw, np.uint8(0))
    raw[stop[~last]] = 32
    inside = np.zeros(len(raw) + 1, np.int8)
    inside[start] = 1
    inside[stop + ~last] -= 1  # where a word begins there, both cancel
    data = raw[np.cumsum(inside[:-1], dtype=np.int8).astype(bool)]
    size = np.bincount(own, stop - start + ~last, n).astype(np.int64)
    offsets = np.concatenate(([0], np.cumsum(size)))
    return pa.LargeStringArray.from_buffers(n, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(data))).cast(pa.string())


def repeated_spans(docs: DataFrame, window: int = 50, id_col: str = "doc_id", text_col: str = "text", block_bytes: int = BLOCK_BYTES, range_keys: int = RANGE_KEYS, fan: int = FAN) -> DataFrame:
    """A row for each document: id, n_words, n_removed, spans (word intervals removed, end exclusive), kept_text."""
    rows, size, n_blocks = blocks(docs, id_col, text_col, block_bytes)
    tree = Tree(n_blocks, size // 6 // range_keys + 1, Later, fan)  # a word has about six bytes

    def send(table: pa.Table) -> pa.Table:
        w = Windows(table, window)
        return tree.messages(w.tracks(), 1, 0, table.column("block")[0].as_py())

    def resolve(left: pa.Table, right: pa.Table) -> pa.Table:
        w = Windows(left, window)
        (elsewhere,), _ = tree.read(w.tracks(), right, 1)
        gone = w.covered(w.flagged(elsewhere))
        words, first, n = w.words, w.words.first, len(w.ids)
        before = np.concatenate(([0], np.cumsum(gone)))
        doc = np.repeat(np.arange(n, dtype=np.int32), words.count)
        # runs of words that go, cut where documents meet
        edge = np.ones(len(gone), bool)
        edge[1:] = (doc[1:] != doc[:-1]) | (gone[1:] != gone[:-1])
        start = np.flatnonzero(edge)
        stop = np.append(start[1:], len(gone))
        start, stop = start[gone[start]], stop[gone[start]]
        base = first[doc[start]]
        spans = pa.StructArray.from_arrays([pa.array(start - base, pa.int32()), pa.array(stop - base, pa.int32())], names=["start", "end"])
        lists = pa.ListArray.from_arrays(pa.array(np.searchsorted(doc[start], np.arange(n + 1)), pa.int32()), spans)
        texts = _kept(words, np.flatnonzero(~gone), doc, n)
        removed = before[first[1:]] - before[first[:-1]]
        return pa.Table.from_arrays([w.raw_ids, pa.array(words.count, pa.int64()), pa.array(removed, pa.int64()), lists, texts], names=["id", "n_words", "n_removed", "spans", "kept_text"])

    told = tree.ask(rows.groupBy("block").applyInArrow(send, ASK))
    return rows.groupBy("block").cogroup(told.groupBy("child")).applyInArrow(resolve, "id bigint, n_words bigint, n_removed bigint, spans array<struct<start:int,end:int>>, kept_text string")
