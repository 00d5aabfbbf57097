"""Toxicity by a factorization machine over hashed terms.

Terms are the lower-case letter runs of a text and their first four and five bytes, hashed to 64 bits; a document has each
term once. The machine scores b + sum of w[i] + sum over pairs of <v[i], v[j]>, so a pair of terms (an insult with a mention
of a group) can weigh what neither does alone. It is fitted on at most `max_rows` labelled rows, drawn by a hash of
their id. The terms that tell the classes apart best (by a likelihood ratio over the distinct texts drawn) have a slot each, and
their log odds start the linear weights. All other terms, however weak or rare, share the rest of the `max_terms` slots by their
hash, so a term that matters only beside another has factors too. Both bounds are parameters. Scoring reads every whole text and broadcasts the model only, whose size the bounds fix.

Defined results: a null or empty text scores the machine's constant; rows without a label are not learned from, and of
repeated labels the larger counts; without both classes the score is the share of toxic labels; extra columns pass through
`drop_toxic`.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize, mix64, named_as, plain
from .words import Words, slices

_APART = np.ones(256, bool)
_APART[48:58] = _APART[97:123] = _APART[128:] = False
FACTORS = 8
#: Cells of the largest table in which documents' slots are marked (a byte each).
CELLS = 1 << 25
#: Squared gradients that a shared slot counts as seen before the first: its linear weight, its factors. Chosen by the logistic loss over three folds
#: inside the rows that may be learned from, at sf0.1, among steps with which made pairs of weak terms are still learned (over 95% of
#: unseen rows right): (1, 0.05) 0.169, (10, 0.05) 0.145, (30, 0.1) 0.134, (10, 0.1) 0.125. Slower factors reach 0.066 but miss such pairs.
STILL = (10.0, 0.1)
THRESHOLD = 0.7


def terms(texts: pa.Array):
    """(first row, rows, document, term) for runs of rows: each word, and its beginnings."""
    for first, part in slices(texts, 1 << 20):
        w = Words(part, lower=True, apart=_APART)
        doc = np.repeat(np.arange(len(part)), w.count)
        yield first, len(part), np.tile(doc, 3), np.concatenate((w.hashes(), w.prefixes(4), w.prefixes(5)))


def _distinct(doc: np.ndarray, term: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    seen = term != 0
    doc, term = doc[seen], term[seen]
    order = np.lexsort((term, doc))
    doc, term = doc[order], term[order]
    new = np.ones(len(doc), bool)
    new[1:] = (doc[1:] != doc[:-1]) | (term[1:] != term[:-1])
    return doc[new], term[new]


class Machine:
    def __init__(self, names: np.ndarray, odds: np.ndarray, seed: int = 11, shared: int = 0):
        """odds: the terms' log odds ratios, from which the linear weights start; shared: slots that all other terms share."""
        rng = np.random.default_rng(seed)
        order = np.argsort(names)
        self.names = names[order].astype(np.uint64)
        self.bias = 0.0
        self.shared = shared
        self.w = np.concatenate((odds[order].astype(float), np.zeros(shared)))
        self.v = rng.normal(0, 0.01, (len(self.w), FACTORS))
        self._filter = np.zeros(1 << 20, bool)
        self._filter[(self.names & np.uint64((1 << 20) - 1)).astype(np.int64)] = True

    def find(self, doc: np.ndarray, term: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The distinct pairs of document and slot, as indices."""
        k = len(self.names)
        if self.shared:
            seen = term != 0
            doc, term = doc[seen], term[seen]
            slot = k + (mix64(term) % np.uint64(self.shared)).astype(np.int64)
        else:
            slot = np.full(len(term), -1, np.int64)
        if k:
            maybe = np.flatnonzero(self._filter[(term & np.uint64((1 << 20) - 1)).astype(np.int64)])
            at = np.minimum(np.searchsorted(self.names, term[maybe]), k - 1)
            hit = self.names[at] == term[maybe]
            slot[maybe[hit]] = at[hit]
        known = slot >= 0
        width = max(len(self.w), 1)
        pairs = doc[known].astype(np.int64) * width + slot[known]
        cells = (int(doc.max()) + 1) * width if len(doc) else 0
        if cells <= CELLS:  # marked in a table, which is cheaper than a sort; very many short texts are sorted
            table = np.zeros(cells, bool)
            table[pairs] = True
            pairs = np.flatnonzero(table)
        else:
            pairs = np.unique(pairs)
        return pairs // width, pairs % width

    def score(self, doc: np.ndarray, at: np.ndarray, n: int) -> np.ndarray:
        z = self.bias + np.bincount(doc, (self.w - 0.5 * (self.v**2).sum(1))[at], n)
        for f in range(FACTORS):
            z += 0.5 * np.bincount(doc, self.v[:, f][at], n) ** 2
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))

    def fit(self, docs: list[np.ndarray], labels: np.ndarray, epochs: int = 40, rate: float = 0.1, decay: float = 1e-4, batch: int = 256, seed: int = 5) -> None:
        """Adagrad on the logistic loss; the rarer class weighs up to ten times."""
        rng = np.random.default_rng(seed)
        n, pos = len(labels), int(labels.sum())
        if not n:
            self.bias = -30.0
            return
        if pos in (0, n):
            self.bias = float(np.clip(np.log((pos + 1e-9) / (n - pos + 1e-9)), -30, 30))
            return
        start = self.w.copy()
        weight = np.where(labels == 1, min(10.0, max(1.0, (n - pos) / pos)), min(10.0, max(1.0, pos / (n - pos))))
        self.bias = float(np.log(pos / (n - pos)))
        size = np.array([len(d) for d in docs])
        begin = np.cumsum(size) - size
        flat = np.concatenate(docs)
        gb, gw, gv = 1e-6, np.full(len(self.w), 1e-6), np.full_like(self.v, 1e-6)
        # shared slots start with a smaller step, or texts would be learned by heart
        gw[len(self.names) :], gv[len(self.names) :] = STILL
        room = np.zeros((min(batch, n), len(self.w)), np.float32)  # batch x max_terms, used again by each step
        for _ in range(epochs):
            order = rng.permutation(n)
            for i in range(0, n, batch):
                rows = order[i : i + batch]
                k = size[rows]
                owner = np.repeat(np.arange(len(rows)), k)
                at = flat[np.arange(int(k.sum())) + np.repeat(begin[rows] - (np.cumsum(k) - k), k)]
                has = room[: len(rows)]
                has.reshape(-1)[owner * len(self.w) + at] = 1
                used = (np.bincount(at, minlength=len(self.w)) > 0).astype(float)
                # by row: the linear sum, the sum of each factor and of all squares
                sums = (has @ np.column_stack((self.w, (self.v**2).sum(1), self.v)).astype(np.float32)).astype(float)
                z = self.bias + sums[:, 0] + 0.5 * ((sums[:, 2:] ** 2).sum(1) - sums[:, 1])
                error = weight[rows] * (1 / (1 + np.exp(-np.clip(z, -30, 30))) - labels[rows]) / len(rows)
                back = (np.vstack((error, error * sums[:, 2:].T)).astype(np.float32) @ has).astype(float)
                has.fill(0)
                dw = used * (back[0] + decay * (self.w - start))
                dv = used[:, None] * (back[1:].T + (decay - back[0])[:, None] * self.v)
                db = float(error.sum())
                gb, gw, gv = gb + db**2, gw + dw**2, gv + dv**2
                self.bias -= rate * db / gb**0.5
                self.w -= rate * dw / np.sqrt(gw)
                self.v -= rate * dv / np.sqrt(gv)


def _rows(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    own, id_, text = plain(docs, id_col, text_col)
    return own.select(id_.cast("bigint").alias("id"), text.cast("string").alias("text"))


def train(docs: DataFrame, labels: DataFrame, learn: Column, max_rows: int = 20_000, max_terms: int = 8_192, min_docs: int = 4, min_odds: float = 1.1, id_col: str = "doc_id", text_col: str = "text") -> Machine:
    """Fit on the labelled rows for which `learn` (over `id`) holds; labels: doc_id and toxic."""
    own = labels.select(F.col("doc_id").alias("id"), F.col("toxic").cast("int").alias("toxic")).where(learn & F.col("toxic").isNotNull() & F.col("id").isNotNull())
    own = own.groupBy("id").agg(F.max("toxic").alias("toxic"))
    # the max_rows smallest hashes: any part of the labels, alike at every size
    drawn = F.broadcast(own.orderBy(F.xxhash64("id"), "id").limit(max_rows))
    rows = _rows(docs, id_col, text_col)
    sample = materialize(rows.join(drawn, "id").groupBy("text").agg(F.max("toxic").alias("toxic")).select("toxic", "text"), "toxicity_rows")
    total = sample.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("toxic"), F.lit(0)).alias("pos")).first()
    n, pos = int(total["n"]), int(total["pos"])

    def count(batches):
        for batch in batches:
            y = batch.column(0).to_numpy(zero_copy_only=False)
            for first, k, doc, term in terms(batch.column(1)):
                doc, term = _distinct(doc, term)
                name, inverse = np.unique(term, return_inverse=True)
                toxic = np.bincount(inverse, y[first : first + k][doc], len(name)).astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(name.view(np.int64)), pa.array(np.bincount(inverse, minlength=len(name)).astype(np.int64)), pa.array(toxic)], names=["term", "n", "pos"])

    counted = sample.mapInArrow(count, "term bigint, n bigint, pos bigint").groupBy("term").agg(F.sum("n").alias("n"), F.sum("pos").alias("pos"))
    counted = counted.where(F.col("n") >= min_docs)
    tested = counted.count()
    # the likelihood-ratio test of the two-by-two table, with its bound raised for the number of terms tested
    a, b = F.col("pos").cast("double"), (F.col("n") - F.col("pos")).cast("double")
    c, d = pos - a, (n - pos) - b
    part = lambda seen, row, col: F.when(seen > 0, seen * F.log(seen * n / (row * col))).otherwise(0.0)
    g2 = 2 * (part(a, a + b, F.lit(float(pos))) + part(b, a + b, F.lit(float(n - pos))) + part(c, c + d, F.lit(float(pos))) + part(d, c + d, F.lit(float(n - pos))))
    odds = F.log((a + 0.5) / (c + 0.5) / ((b + 0.5) / (d + 0.5)))
    strong = counted.select("term", g2.alias("g2"), odds.alias("odds")).where((F.col("g2") >= 2 * np.log(tested + 1.0) + 2) & (F.abs("odds") >= min_odds))
    best = strong.orderBy(F.desc("g2"), "term").limit(max_terms // 2).collect()  # the others share slots
    machine = Machine(np.array([r["term"] for r in best], np.int64).view(np.uint64), np.clip(np.array([r["odds"] for r in best], float), -6, 6), shared=max_terms - len(best))

    slot = np.dtype(np.uint16 if len(machine.w) <= 1 << 16 else np.int32)

    def features(batches):
        for batch in batches:
            y = batch.column(0)
            for first, k, doc, term in terms(batch.column(1)):
                doc, at = machine.find(doc, term)
                ends = np.searchsorted(doc, np.arange(k + 1))
                at = at.astype(slot)
                lists = [at[i:j].tobytes() for i, j in zip(ends, ends[1:], strict=False)]
                yield pa.RecordBatch.from_arrays([y.slice(first, k).cast(pa.int32()), pa.array(lists, pa.binary())], names=["toxic", "at"])

    got = sample.mapInArrow(features, "toxic int, at binary").collect()  # max_rows rows
    got.sort(key=lambda r: (r["toxic"], r["at"]))  # the same order in every run
    machine.fit([np.frombuffer(r["at"], slot) for r in got], np.array([r["toxic"] for r in got], np.int64))
    return machine


def score(docs: DataFrame, machine: Machine, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row for each document: id, score."""

    def run(batches):
        for batch in batches:
            for first, k, doc, term in terms(batch.column(1)):
                doc, at = machine.find(doc, term)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, k), pa.array(machine.score(doc, at, k))], names=["id", "score"])

    return _rows(docs, id_col, text_col).mapInArrow(run, "id bigint, score double")


def drop_toxic(docs: DataFrame, machine: Machine, threshold: float = THRESHOLD, text_col: str = "text") -> DataFrame:
    """The documents under the threshold, with all their columns."""
    own, _ = plain(docs, text_col)
    place = [c.lower() for c in docs.columns].index(text_col.lower()) if text_col not in docs.columns else docs.columns.index(text_col)

    def run(batches):
        for batch in batches:
            keep = np.ones(len(batch), bool)
            for first, k, doc, term in terms(batch.column(place)):
                doc, at = machine.find(doc, term)
                keep[first : first + k] = machine.score(doc, at, k) < threshold
            yield batch.filter(pa.array(keep))

    return named_as(own.mapInArrow(run, own.schema), docs)
