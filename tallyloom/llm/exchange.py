"""Counting very many 64-bit keys over a corpus with small shuffles.

Documents are dealt to blocks by hash. A block sends each distinct key once, sorted and packed, to the range of keys that owns it; the
range merges what came and answers with one value for each key in the same order, so answers need no keys. With many blocks
this goes through a tree of a bounded fan-out: a node takes the messages of at most `fan` children for one range of keys, merges equal
keys, and passes them on to at most `fan` narrower ranges; answers return the same way. So a block sends at most `fan`
messages, each node handles about as many keys as a block has, a key that all blocks have costs a node `fan` entries at most, and messages
grow in proportion to the blocks. Up to `fan` blocks and ranges the tree has one level.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import plain, text_of

#: Bytes of text in a block, keys in a range, on average, and children of a node, at most.
BLOCK_BYTES = 6 << 20
RANGE_KEYS = 1_000_000
FAN = 256


def blocks(docs: DataFrame, id_col: str, text_col: str, block_bytes: int = BLOCK_BYTES) -> tuple[DataFrame, int, int]:
    """(id, text, block), the bytes of all texts and the number of blocks. There are as many partitions as blocks, so few blocks share one."""
    own, id_, text = plain(docs, id_col, text_col)
    text = text_of(text)
    size = own.agg(F.sum(F.octet_length(text)).alias("n")).first()["n"] or 0
    n = int(size) // block_bytes + 1
    rows = own.select(id_.cast("bigint").alias("id"), text.alias("text"))
    return rows.withColumn("block", F.pmod(F.xxhash64("id", "text"), F.lit(n)).cast("bigint")).repartition(n, "block"), int(size), n


def pack(values: np.ndarray, delta: bool = False) -> bytes:
    """Integers as bytes: differences if they rise, bytes of one weight together, then zstd."""
    if delta and len(values):
        values = np.concatenate((values[:1], np.diff(values)))
    planes = np.ascontiguousarray(values.astype(values.dtype.newbyteorder("<"))).view(np.uint8).reshape(len(values), -1).T
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(planes).tobytes())


def unpack(data: bytes, dtype, delta: bool = False) -> np.ndarray:
    kind = np.dtype(dtype)
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8)
    values = np.ascontiguousarray(raw.reshape(kind.itemsize, -1).T).reshape(-1).view(kind)
    return np.cumsum(values, dtype=kind) if delta else values


class Total:
    """Values of equal keys add up; the answer is their sum over the corpus."""

    how = np.add

    @staticmethod
    def at_root(merged: np.ndarray) -> np.ndarray:
        return merged

    @staticmethod
    def for_child(own: np.ndarray, merged: np.ndarray, answer: np.ndarray) -> np.ndarray:
        return answer

    @staticmethod
    def write(answer: np.ndarray) -> bytes | None:
        return pack(answer)

    @staticmethod
    def read(data: bytes, n: int) -> np.ndarray:
        return unpack(data, np.int64)

    nothing = np.int64(0)


class Later:
    """The answer is whether a smaller value than the block's own exists; what is not sent is False."""

    how = np.minimum

    @staticmethod
    def at_root(merged: np.ndarray) -> np.ndarray:
        return np.zeros(len(merged), bool)

    @staticmethod
    def for_child(own: np.ndarray, merged: np.ndarray, answer: np.ndarray) -> np.ndarray:
        return answer | (own > merged)

    @staticmethod
    def write(answer: np.ndarray) -> bytes | None:
        return np.packbits(answer).tobytes() if answer.any() else None

    @staticmethod
    def read(data: bytes, n: int) -> np.ndarray:
        return np.unpackbits(np.frombuffer(data, np.uint8), count=n).astype(bool)

    nothing = np.bool_(False)


Tracks = list[tuple[np.ndarray, np.ndarray]]  # sorted distinct keys and their values, a pair for each kind of key
ASK = "g bigint, r bigint, child bigint, sizes array<int>, keys binary, vals binary"
TELL = "child bigint, r bigint, found bigint, vals binary"
_ASK = pa.schema([("g", pa.int64()), ("r", pa.int64()), ("child", pa.int64()), ("sizes", pa.list_(pa.int32())), ("keys", pa.binary()), ("vals", pa.binary())])
_TELL = pa.schema([("child", pa.int64()), ("r", pa.int64()), ("found", pa.int64()), ("vals", pa.binary())])


class Tree:
    def __init__(self, n_blocks: int, ranges: int, kind, fan: int = FAN):
        wide = max(n_blocks, ranges, 1)
        self.kind, self.levels = kind, 1
        while fan**self.levels < wide:
            self.levels += 1
        if self.levels == 1:
            self.fan = ranges
        else:
            self.fan = 2
            while self.fan**self.levels < wide:
                self.fan += 1
        self.nodes = self.fan**self.levels
        self.step = (1 << 64) // self.fan**self.levels + 1

    def cut(self, keys: np.ndarray, level: int, prefix: int = 0) -> np.ndarray:
        """Where each child range begins among the keys of a range (one more entry than children); level: of the children, from 1."""
        width = self.step * self.fan ** (self.levels - level)
        return np.append(np.searchsorted(keys, np.array([(prefix * self.fan + d) * width for d in range(self.fan)], np.uint64)), len(keys))

    def messages(self, tracks: Tracks, level: int, prefix: int, sender: int) -> pa.Table:
        """A row for each child range that has keys."""
        cuts = [self.cut(k, level, prefix) for k, _ in tracks]
        group = 0 if level == self.levels else sender // self.fan
        out = []
        for d in range(self.fan):
            own = [slice(c[d], c[d + 1]) for c in cuts]
            sizes = [s.stop - s.start for s in own]
            if sum(sizes):
                # keys of a track rise; a track begins lower than the last ended
                keys = np.concatenate([k[s] for (k, _), s in zip(tracks, own, strict=True)])
                vals = np.concatenate([v[s] for (_, v), s in zip(tracks, own, strict=True)])
                out.append({"g": group, "r": prefix * self.fan + d, "child": sender, "sizes": sizes, "keys": pack(keys, True), "vals": pack(vals.astype(np.int64))})
        return pa.Table.from_pylist(out, _ASK)

    def _merged(self, table: pa.Table):
        """The senders, the merged tracks, and for each sender and track its values and where its keys are among the merged ones."""
        rows = table.select(["child", "sizes", "keys", "vals"]).to_pylist()
        split = [np.cumsum(r["sizes"])[:-1] for r in rows]
        keys = [np.split(unpack(r["keys"], np.uint64, True), s) for r, s in zip(rows, split, strict=True)]
        vals = [np.split(unpack(r["vals"], np.int64), s) for r, s in zip(rows, split, strict=True)]
        tracks, inverse = [], []
        for t in range(len(rows[0]["sizes"])):
            every, value = np.concatenate([k[t] for k in keys]), np.concatenate([v[t] for v in vals])
            order = np.argsort(every, kind="stable")
            ranked = every[order]
            new = np.ones(len(ranked), bool)
            new[1:] = ranked[1:] != ranked[:-1]
            first = np.flatnonzero(new)
            tracks.append((ranked[first], self.kind.how.reduceat(value[order], first) if len(first) else value))
            at = np.empty(len(order), np.int64)
            at[order] = np.cumsum(new) - 1
            inverse.append(np.split(at, np.cumsum([len(k[t]) for k in keys])[:-1]))
        return [r["child"] for r in rows], tracks, vals, inverse

    def _answers(self, prefix: int, found: int, answers: list[np.ndarray], senders, tracks, vals, inverse) -> pa.Table:
        out = []
        for i, child in enumerate(senders):
            own = [self.kind.for_child(vals[i][t], tracks[t][1][inverse[t][i]], answers[t][inverse[t][i]]) for t in range(len(tracks))]
            data = self.kind.write(np.concatenate(own))
            if data is not None or (found and i == 0):
                out.append({"child": child, "r": prefix, "found": found if i == 0 else 0, "vals": data})
        return pa.Table.from_pylist(out, _TELL)

    def _root(self, table: pa.Table) -> pa.Table:
        senders, tracks, vals, inverse = self._merged(table)
        found = int((tracks[0][1] > 0).sum())
        return self._answers(table.column("r")[0].as_py(), found, [self.kind.at_root(v) for _, v in tracks], senders, tracks, vals, inverse)

    def read(self, tracks: Tracks, told: pa.Table, level: int, prefix: int = 0) -> tuple[list[np.ndarray], int]:
        """The answers for the keys of a sender, from what the child ranges told, and what they found."""
        cuts = [self.cut(k, level, prefix) for k, _ in tracks]
        out = [np.full(len(k), self.kind.nothing) for k, _ in tracks]
        found = 0
        for r in told.to_pylist():
            found += r["found"]
            if r["vals"] is not None:
                d = r["r"] - prefix * self.fan
                sizes = [int(c[d + 1] - c[d]) for c in cuts]
                for t, part in enumerate(np.split(self.kind.read(r["vals"], sum(sizes)), np.cumsum(sizes)[:-1])):
                    out[t][cuts[t][d] : cuts[t][d + 1]] = part
        return out, found

    def ask(self, asked: DataFrame) -> DataFrame:
        """Answers (child, r, found, vals) to the blocks, from their messages; found: keys of the first kind with a value above 0, counted once each.

        asked: rows of `messages(tracks, 1, 0, block)`.
        """
        dealt = lambda rows: rows.repartition(self.nodes, "g", "r")
        sent = [dealt(asked)]
        for level in range(1, self.levels):
            sent.append(dealt(sent[-1].groupBy("g", "r").applyInArrow(self._forward(level), ASK)))
        told = sent[-1].groupBy("g", "r").applyInArrow(lambda table: self._root(table), TELL)
        for level in range(self.levels - 1, 0, -1):
            up = told.withColumn("node", F.expr(f"r div {self.fan}"))
            told = sent[level - 1].groupBy("g", "r").cogroup(up.groupBy("child", "node")).applyInArrow(self._back(level), TELL)
        return told

    def _forward(self, level: int):
        def forward(table: pa.Table) -> pa.Table:
            _, tracks, _, _ = self._merged(table)
            return self.messages(tracks, level + 1, table.column("r")[0].as_py(), table.column("g")[0].as_py())

        return forward

    def _back(self, level: int):
        def back(left: pa.Table, right: pa.Table) -> pa.Table:
            if not len(left):
                return _TELL.empty_table()
            senders, tracks, vals, inverse = self._merged(left)
            prefix = left.column("r")[0].as_py()
            answers, found = self.read(tracks, right, level + 1, prefix)
            return self._answers(prefix, found, answers, senders, tracks, vals, inverse)

        return back
