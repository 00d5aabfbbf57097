"""Canonical length-limited Huffman codes over integer ids, and bit streams in blocks, with numpy."""

from __future__ import annotations

import numpy as np


def code_lengths(counts: np.ndarray, most: int) -> np.ndarray:
    """The best code lengths of at most `most` bits for counts of at least 1 (package-merge)."""
    n = len(counts)
    if n <= 1:
        return np.ones(n, np.int64)
    if n > 1 << most:
        raise ValueError(f"{n} ids need codes of more than {most} bits")
    order = np.argsort(counts, kind="stable")
    leaf = counts[order].astype(np.float64)
    levels = []
    packages = np.zeros(0)
    for _ in range(most):
        both = np.concatenate((leaf, packages))
        by = np.argsort(both, kind="stable")
        levels.append(by < n)
        both = both[by]
        even = len(both) // 2 * 2
        packages = both[0:even:2] + both[1:even:2]
    lengths = np.zeros(n, np.int64)
    take = 2 * n - 2
    for is_leaf in reversed(levels):
        leaves = int(is_leaf[:take].sum())
        lengths[:leaves] += 1
        take = 2 * (take - leaves)
    out = np.zeros(n, np.int64)
    out[order] = lengths
    return out


class Code:
    """A canonical code: ids in order of (length, id) get rising code words."""

    def __init__(self, ids: np.ndarray, lengths: np.ndarray):
        self.ids, self.lengths = np.asarray(ids, np.int64), np.asarray(lengths, np.int64)
        self.most = int(self.lengths.max(initial=1))
        order = np.lexsort((self.ids, self.lengths))
        span = np.int64(1) << (self.most - self.lengths[order])
        begin = np.cumsum(span) - span
        size = int(self.ids.max(initial=0)) + 1
        self.word, self.bits = np.zeros(size, np.uint64), np.zeros(size, np.int64)
        self.word[self.ids[order]] = (begin >> (self.most - self.lengths[order])).astype(np.uint64)
        self.bits[self.ids[order]] = self.lengths[order]
        #: by the next `most` bits: the id and the length of its code
        self.to_id = np.zeros(1 << self.most, np.int32)
        self.to_bits = np.ones(1 << self.most, np.uint8)
        self.to_id[: int(span.sum())] = np.repeat(self.ids[order], span)
        self.to_bits[: int(span.sum())] = np.repeat(self.lengths[order], span)

    def encode(self, ids: np.ndarray, block: int) -> tuple[bytes, np.ndarray]:
        """The bit stream, and the bit at which each block of `block` ids begins."""
        if not len(ids):
            return b"", np.zeros(0, np.int64)
        bits = self.bits[ids]
        end = np.cumsum(bits)
        start = end - bits
        word, value = start >> 6, self.word[ids]
        room = 64 - (start & 63) - bits
        over = np.flatnonzero(room < 0)
        head = value << np.maximum(room, 0).astype(np.uint64)
        head[over] = value[over] >> (-room[over]).astype(np.uint64)
        first = np.flatnonzero(np.append(True, word[1:] != word[:-1]))
        out = np.zeros(int(word[-1]) + 2, np.uint64)
        out[word[first]] = np.bitwise_or.reduceat(head, first)
        out[word[over] + 1] |= value[over] << (64 + room[over]).astype(np.uint64)
        return out.astype(">u8").tobytes()[: int(end[-1] + 7) // 8], start[::block]

    def decode(self, payload: bytes, n: int, starts: np.ndarray, block: int) -> np.ndarray:
        """The n ids. All blocks go step by step together, each from its own checkpoint."""
        if not n:
            return np.zeros(0, np.int32)
        b = np.frombuffer(payload + bytes(8), np.uint8).astype(np.uint32)
        ahead = (b[:-3] << np.uint32(24)) | (b[1:-2] << np.uint32(16)) | (b[2:-1] << np.uint32(8)) | b[3:]
        at = np.asarray(starts, np.int64).copy()
        blocks = len(at)
        out = np.zeros((block, blocks), np.int32)
        shift = 32 - self.most
        tail = n - (blocks - 1) * block
        for step in range(min(block, n)):
            live = blocks if step < tail else blocks - 1
            if not live:
                break
            a = at[:live]
            key = (ahead[a >> 3] << (a & 7).astype(np.uint32)) >> np.uint32(shift)
            out[step, :live] = self.to_id[key]
            a += self.to_bits[key]
        return out.T.reshape(-1)[:n]
