"""Language-model scores by deleted interpolation.

The model mixes three estimates of a word after its context: bigram and unigram maximum likelihood and a uniform
share. The weights depend on how often the context was seen: contexts fall into buckets by the power of two of their count. Weights
are learned by expectation-maximisation on held-out counts, which deletion gives: each training token is predicted from
the counts without itself. A word's context is the word before it; the end token is the context of a first word.

Counting: each block of documents sends its distinct words and word pairs as 64-bit hashes with their training counts up a tree of
bounded fan-out (`exchange`) and gets the corpus counts back. What a block then knows
of each of its tokens (counts of the pair and of the word) is written once; the weights' statistics and the scores
are two passes over that table. The statistics round the two estimates to a quarter of a power of two,
which bounds what comes to the driver.

Defined results: a null text is empty and has the end token only; a row with a null id is learned from like any other unless `held` says otherwise (a null there means learned from);
repeated rows count each; without training rows all scores come from the uniform share; extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import free_shuffles, materialize, mix64
from .exchange import ASK, BLOCK_BYTES, FAN, RANGE_KEYS, Total, Tree, blocks, pack, unpack
from .words import Words, distinct

END = np.uint64(0x5851F42D4C957F2D)
PAIR = np.uint64(0xDA942042E4DD58B5)
#: Steps of the rounding, in parts of a power of two, and its smallest value.
STEP, LOWEST = 4, -44


class Block:
    """Tokens of a block: their words, and the pairs with the word before."""

    def __init__(self, table: pa.Table):
        self.ids = table.column("id").combine_chunks()
        self.held = table.column("held").combine_chunks().to_numpy(zero_copy_only=False)
        words = Words(table.column("text").combine_chunks(), lower=True)
        self.n = words.count + 1
        self.at = np.concatenate(([0], np.cumsum(self.n)))
        token = np.full(int(self.at[-1]), END, np.uint64)
        place = np.arange(len(words.start)) + np.repeat(np.arange(len(self.n)), words.count)
        token[place] = words.hashes()
        before = np.full_like(token, END)
        before[1:] = token[:-1]
        before[self.at[:-1]] = END
        self.train = np.repeat(~self.held, self.n)
        before *= PAIR
        before += token
        self.word, _, self.word_of = distinct(token)
        del token
        self.pair, _, self.pair_of = distinct(mix64(before))

    def tracks(self) -> list[tuple[np.ndarray, np.ndarray]]:
        """Words and pairs with their training counts."""
        return [(keys, np.bincount(of, self.train, len(keys)).astype(np.int64)) for keys, of in ((self.word, self.word_of), (self.pair, self.pair_of))]


KNOWN = "ids array<bigint>, held array<boolean>, n array<bigint>, n_types bigint, n_train bigint, word binary, pair binary, context binary"


def _know(left: pa.Table, right: pa.Table, tree: Tree) -> pa.Table:
    b = Block(left)
    (word, pair), types = tree.read(b.tracks(), right, 1)
    # the context's count follows from the words: it is the count of the token before, or of the end token
    end = word[np.searchsorted(b.word, END)]
    cols = [[b.ids.to_pylist()], [b.held.tolist()], [b.n.tolist()], [types], [int(b.train.sum())], [pack(word[b.word_of])], [pack(pair[b.pair_of])], [pack(np.array([end]))]]
    fields = [pa.list_(pa.int64()), pa.list_(pa.bool_()), pa.list_(pa.int64()), pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.binary()]
    return pa.Table.from_arrays([pa.array(c, t) for c, t in zip(cols, fields, strict=True)], names=["ids", "held", "n", "n_types", "n_train", "word", "pair", "context"])


def _tokens(r: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Tokens in each document, and by token the counts of the word, the pair and the context."""
    n = np.array(r["n"], np.int64)
    word, pair = unpack(r["word"], np.int64), unpack(r["pair"], np.int64)
    context = np.empty_like(word)
    context[1:] = word[:-1]
    context[np.cumsum(n) - n] = unpack(r["context"], np.int64)[0]
    return n, word, pair, context


def bucket(context: np.ndarray) -> np.ndarray:
    """0 for a context that was never seen, else 1 + the power of two of its count."""
    return np.where(context > 0, np.log2(np.maximum(context, 1)).astype(np.int64) + 1, 0)


def _rounded(p: np.ndarray) -> np.ndarray:
    with np.errstate(divide="ignore"):
        return np.where(p > 0, np.maximum(np.round(np.log2(p) * STEP), LOWEST * STEP), LOWEST * STEP - 1).astype(np.int64)


def _value(q: np.ndarray) -> np.ndarray:
    return np.where(q < LOWEST * STEP, 0.0, 2.0 ** (q / STEP))


def learn(cells: list[tuple[int, int, int, int]], types: int, rounds: int = 60) -> np.ndarray:
    """Weights (bigram, unigram, uniform) of each bucket, from (bucket, rounded bigram, rounded unigram, tokens)."""
    weights = np.tile(np.array([0.0, 0.9, 0.1]), (64, 1))
    if not cells:
        return np.tile(np.array([0.0, 0.0, 1.0]), (64, 1))
    c = np.array(cells, np.int64)
    p = np.stack((_value(c[:, 1]), _value(c[:, 2]), np.full(len(c), 1.0 / (types + 1))), 1)
    for b in np.unique(c[:, 0]):
        own = c[:, 0] == b
        n, q, w = c[own, 3].astype(float), p[own], np.full(3, 1 / 3)
        for _ in range(rounds):
            part = q * w
            # one token's worth of each keeps every weight above 0
            w = (n[:, None] * part / part.sum(1, keepdims=True)).sum(0) + 1e-3
            w /= w.sum()
        weights[b] = w
    seen = np.unique(c[:, 0])
    for b in range(int(seen.max()) + 1, 64):  # more frequent contexts than any of the training
        weights[b] = weights[seen.max()]
    return weights


def score(docs: DataFrame, held, id_col: str = "doc_id", text_col: str = "text", block_bytes: int = BLOCK_BYTES, range_keys: int = RANGE_KEYS, fan: int = FAN) -> DataFrame:
    """A row for each document: id, held_out, n_tokens, n_known, train_tokens, base_score, score.

    held: a boolean Column over `id`; rows where it is true are scored but not learned from.
    """
    spark = docs.sparkSession
    rows, size, n_blocks = blocks(docs, id_col, text_col, block_bytes)
    rows = rows.select("id", "text", "block", F.coalesce(held, F.lit(False)).alias("held"))
    tree = Tree(n_blocks, size // 8 // range_keys + 1, Total, fan)  # about eight bytes of text for each key
    asked = rows.groupBy("block").applyInArrow(lambda t: tree.messages(Block(t).tracks(), 1, 0, t.column("block")[0].as_py()), ASK)
    told = tree.ask(asked)
    known = materialize(rows.groupBy("block").cogroup(told.groupBy("child")).applyInArrow(lambda a, b: _know(a, b, tree), KNOWN), "known_counts", "none")
    del asked, told
    free_shuffles(spark)
    sums = known.agg(F.sum("n_types").alias("types"), F.sum("n_train").alias("tokens")).first()
    types, tokens = int(sums["types"] or 0), int(sums["tokens"] or 0)

    def statistics(batches):
        for batch in batches:
            for r in batch.to_pylist():
                n, word, pair, context = _tokens(r)
                train = np.repeat(~np.array(r["held"], bool), n)
                word, pair, context = word[train] - 1, pair[train] - 1, context[train] - 1
                one = _rounded(word / max(tokens - 1, 1))
                two = _rounded(pair / np.maximum(context, 1))
                cell = (bucket(context) << 40) | ((two + 512) << 20) | (one + 512)
                cells, count = np.unique(cell, return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(cells), pa.array(count, pa.int64())], names=["cell", "n"])

    cells = known.select("held", "n", "word", "pair", "context").mapInArrow(statistics, "cell bigint, n bigint").groupBy("cell").agg(F.sum("n").alias("n")).collect()  # bounded by the rounding
    mask = (1 << 20) - 1
    weights = learn([(r["cell"] >> 40, (r["cell"] >> 20 & mask) - 512, (r["cell"] & mask) - 512, r["n"]) for r in cells], types)

    def scores(batches):
        for batch in batches:
            for r in batch.to_pylist():
                n, word, pair, context = _tokens(r)
                w = weights[bucket(context)]
                p = w[:, 0] * pair / np.maximum(context, 1) + w[:, 1] * word / max(tokens, 1) + w[:, 2] / (types + 1)
                at = np.cumsum(n) - n
                base = np.log10((word + 0.1) / (tokens + 0.1 * (types + 1)))
                out = [pa.array(r["ids"], pa.int64()), pa.array(r["held"], pa.bool_()), pa.array(n), pa.array(np.add.reduceat(word > 0, at, dtype=np.int64))]
                out += [pa.array(np.full(len(n), tokens, np.int64)), pa.array(np.add.reduceat(base, at)), pa.array(np.add.reduceat(np.log10(p), at))]
                yield pa.RecordBatch.from_arrays(out, names=["id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    return known.mapInArrow(scores, "id bigint, held_out boolean, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double")
