"""Ranked lexical search by sort-based accumulation: the best documents for each item of a query table.

Documents stay in their partitions, which are ranges of the table: all impacts of a document on an item arise in one task, so none is shuffled. A task
takes its texts in slices of bounded size. Words that are terms of items are found by 64-bit hashes, counted by document and term, and each
count becomes an impact for every item that has the term. The item-document-impact arrays of many documents are concatenated,
radix-sorted by the packed key (item, document), and equal keys are summed with `reduceat`; sums that reach an item's worst kept score go to
its heap. A task gives `k` rows for an item at most; these are merged in two steps, by ranges of tasks and then by item.

Statistics come from a pass before: documents with a term, all terms, and documents by term, summed in each task before they move. Items are taken in groups
of about `group_terms` distinct item-term pairs, by a hash of their id; only one group's pairs are sent to the tasks, and each group reads
the documents once for the statistics and once for the search.

A wrong match of two unequal words by their hash is expected (distinct words) x (distinct terms) / 2^64 times: 5e-8 for 1e9 words and 1,000 terms.

Defined results: null and empty texts have no terms, are in no ranking and not counted; rows that share an item id are one item with the terms of all
of them, null ids too; repeated documents are ranked each, and a null id comes last among equal scores; items without
terms, or whose terms no document has, give no rows; empty tables give none. Extra columns do not matter. A very long text is a slice of its own: about 15
bytes for each of its bytes while its words are hashed. An item of n distinct terms takes 16 n bytes in each task.
"""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import id_key, materialize, plain, text_of
from .words import Words, slices

#: By byte: no part of a term. Letters, digits and all bytes of signs beyond ASCII are.
APART = np.array([b < 0x80 and not chr(b).isalnum() for b in range(256)])
#: Bytes of text in a slice, impacts that are sorted at a time, item-term pairs in a group of items.
SLICE = 4 << 20
AT_ONCE = 1 << 21
GROUP_TERMS = 250_000
_TERM = pa.schema([("item", pa.string()), ("term", pa.int64())])
_STAT = pa.schema([("what", pa.int32()), ("n", pa.int64())])
_HIT = pa.schema([("item", pa.int32()), ("doc_id", pa.int64()), ("score", pa.int64())])
#: Rows of _STAT beside those of terms.
DOCUMENTS, TERMS = -1, -2


def radix(keys: np.ndarray, low: int = 0) -> np.ndarray:
    """The stable order of unsigned keys: 16 bits at a time from bit `low` on, by counting sort. Lower bits must rise already."""
    order = np.arange(len(keys))
    top = int(keys.max(initial=0))
    for shift in range(low, 64, 16):
        if top >> shift:
            order = order[np.argsort((keys[order] >> np.uint64(shift)).astype(np.uint16), kind="stable")]
    return order


def runs(ranked: np.ndarray) -> np.ndarray:
    """Where each run of equal values begins."""
    new = np.ones(len(ranked), bool)
    new[1:] = ranked[1:] != ranked[:-1]
    return np.flatnonzero(new)


class Group:
    """The terms of a group of items: rising hashes, and for each its items, end to end."""

    def __init__(self, terms: np.ndarray, items: np.ndarray, n_items: int):
        order = np.lexsort((items, terms))
        ranked = terms[order]
        first = runs(ranked)
        self.terms, self.items, self.n_items = ranked[first], items[order].astype(np.uint64), n_items
        self.start, self.size = first, np.diff(np.append(first, len(ranked)))
        self.weight = np.zeros(len(first), np.int64)

    def weigh(self, documents: int, held: np.ndarray) -> None:
        """held: documents that hold each term."""
        self.weight = np.floor(1000 * np.log((2.0 * documents + 2) / (2.0 * held + 1))).astype(np.int64)

    def counts(self, texts: pa.Array):
        """Of a slice: number of terms of each text, and (text, term of the group, occurrences), by text and term."""
        words = Words(texts, lower=True, apart=APART)
        hashes = words.hashes()
        at = np.searchsorted(self.terms, hashes)
        at[at == len(self.terms)] = 0
        found = np.flatnonzero(self.terms[at] == hashes) if len(self.terms) else np.zeros(0, np.int64)
        text = np.repeat(np.arange(len(words.count)), words.count)[found]
        keys = (text.astype(np.uint64) << np.uint64(32)) | at[found].astype(np.uint64)
        keys = keys[radix(keys)]
        first = runs(keys)
        tf = np.diff(np.append(first, len(keys)))
        return words.count, (keys[first] >> np.uint64(32)).astype(np.int64), (keys[first] & np.uint64(0xFFFFFFFF)).astype(np.int64), tf


class Heaps:
    """The k best documents of each item so far: highest score, then smallest id; a null id is the last."""

    def __init__(self, n_items: int, k: int):
        self.k, self.of, self.least = k, [[] for _ in range(n_items)], np.ones(n_items, np.int64)

    def add(self, items: np.ndarray, scores: np.ndarray, ids: np.ndarray, unknown: np.ndarray) -> None:
        able = np.flatnonzero(scores >= self.least[items])
        for item, score, id_, null in zip(items[able].tolist(), scores[able].tolist(), ids[able].tolist(), unknown[able].tolist(), strict=True):
            heap, entry = self.of[item], (score, float("-inf") if null else -id_)
            if len(heap) < self.k:
                heapq.heappush(heap, entry)
            elif entry > heap[0]:
                heapq.heapreplace(heap, entry)
            if len(heap) == self.k:
                self.least[item] = heap[0][0]

    def rows(self) -> pa.RecordBatch:
        out = [(i, None if name == float("-inf") else -name, score) for i, heap in enumerate(self.of) for score, name in heap]
        return pa.RecordBatch.from_pylist([dict(zip(_HIT.names, r, strict=True)) for r in out], _HIT)


def accumulate(group: Group, texts: pa.Array, documents: int, all_terms: int):
    """(items, texts, scores) of a slice, in runs of about AT_ONCE impacts; a document is never cut."""
    length, doc, term, tf = group.counts(texts)
    useful = group.weight[term] > 0  # a weight of 0 adds nothing
    doc, term, tf = doc[useful], term[useful], tf[useful]
    if not len(doc):
        return
    m = 50 + (50 * length.astype(np.int64) * documents) // all_terms
    impact = group.weight[term] * ((1_000_000_000 * tf) // (1000 * tf + 20 * m[doc]))
    sizes = group.size[term]
    begins = runs(doc)
    ends = np.append(begins[1:], len(doc))
    chunk = (np.cumsum(sizes)[ends - 1] - 1) // AT_ONCE
    firsts = begins[runs(chunk)]
    for a, b in zip(firsts, np.append(firsts[1:], len(doc)), strict=True):
        n = sizes[a:b]
        inner = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
        keys = (group.items[inner + np.repeat(group.start[term[a:b]], n)] << np.uint64(32)) | np.repeat(doc[a:b].astype(np.uint64), n)
        order = radix(keys, 32)  # documents rise already
        keys = keys[order]
        first = runs(keys)
        scores = np.add.reduceat(np.repeat(impact[a:b], n)[order], first)
        yield (keys[first] >> np.uint64(32)).astype(np.int64), (keys[first] & np.uint64(0xFFFFFFFF)).astype(np.int64), scores


def item_terms(items: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(item, term): the distinct terms of each item, by hash. item: its id as text, empty for null."""
    own, id_, text = plain(items, id_col, text_col)

    def run(batches):
        for b in batches:
            for start, part in slices(b.column(1), SLICE):
                w = Words(part, lower=True, apart=APART)
                at = pa.array(np.repeat(np.arange(len(w.count)), w.count) + start)
                yield pa.RecordBatch.from_arrays([b.column(0).take(at), pa.array(w.hashes().view(np.int64))], schema=_TERM)

    rows = own.select(id_key(id_.cast("bigint")).alias("item"), text_of(text).alias("text"))
    return rows.mapInArrow(run, "item string, term bigint").distinct()


def statistics(docs: DataFrame, group: Group) -> tuple[int, int, np.ndarray]:
    """Documents that have a term, terms of all documents, and by term of the group the documents that hold it."""

    def run(batches):
        held, documents, every = np.zeros(len(group.terms), np.int64), 0, 0
        for b in batches:
            for _, part in slices(b.column(1), SLICE):
                length, _, term, _ = group.counts(part)
                documents, every = documents + int((length > 0).sum()), every + int(length.sum())
                held += np.bincount(term, minlength=len(held))
        some = np.flatnonzero(held)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(some, [DOCUMENTS, TERMS]), pa.int32()), pa.array(np.append(held[some], [documents, every]), pa.int64())], schema=_STAT)

    told = docs.mapInArrow(run, "what int, n bigint").groupBy("what").agg(F.sum("n").alias("n")).collect()  # a row for each term of the group, at most
    held = np.zeros(len(group.terms), np.int64)
    by = {r["what"]: r["n"] for r in told}
    for what, n in by.items():
        if what >= 0:
            held[what] = n
    return by.get(DOCUMENTS, 0), by.get(TERMS, 0), held


def best(docs: DataFrame, group: Group, documents: int, all_terms: int, k: int) -> DataFrame:
    """(item, doc_id, score): the k best of each task for each item of the group."""

    def run(batches):
        heaps = Heaps(group.n_items, k)
        for b in batches:
            for start, part in slices(b.column(1), SLICE):
                ids = b.column(0).slice(start, len(part))
                known, unknown = ids.fill_null(0).to_numpy(), ids.is_null().to_numpy(zero_copy_only=False)
                for items, texts, scores in accumulate(group, part, documents, all_terms):
                    heaps.add(items, scores, known[texts], unknown[texts])
        yield heaps.rows()

    return docs.mapInArrow(run, "item int, doc_id bigint, score bigint")


def search(docs: DataFrame, items: DataFrame, id_col: str, text_col: str, item_col: str, item_text_col: str, k: int = 50, group_terms: int = GROUP_TERMS) -> DataFrame:
    """(item_id, rank, doc_id, score): for each item its k best documents with a score above 0."""
    own, id_, text = plain(docs, id_col, text_col)
    rows = own.select(id_.cast("bigint").alias("doc_id"), text_of(text).alias("text"))
    pairs = materialize(item_terms(items, item_col, item_text_col), "item_terms")
    n_groups = pairs.count() // group_terms + 1
    out = None
    for g in range(n_groups):
        mine = pairs.where(F.pmod(F.xxhash64("item"), F.lit(n_groups)) == g).toPandas()
        place = {x: i for i, x in enumerate(mine["item"].unique())}
        group = Group(mine["term"].to_numpy(np.int64).view(np.uint64), mine["item"].map(place).to_numpy(np.int64), len(place))
        documents, all_terms, held = statistics(rows, group)
        if not documents:
            continue
        group.weigh(documents, held)
        of = docs.sparkSession.createDataFrame([(i, int(x[1:]) if x else None) for x, i in place.items()], "item int, item_id bigint")
        hits = best(rows, group, documents, all_terms, k).withColumn("range", F.spark_partition_id() % 1024)
        order = [F.desc("score"), F.asc_nulls_last("doc_id")]
        for keys in (["item", "range"], ["item"]):  # a range of tasks first, so that no group holds the rows of all tasks
            hits = hits.withColumn("rank", F.row_number().over(W.partitionBy(*keys).orderBy(*order))).where(F.col("rank") <= k)
        found = hits.join(F.broadcast(of), "item").select("item_id", "rank", "doc_id", "score")
        out = found if out is None else out.unionByName(found)
    empty = docs.sparkSession.createDataFrame([], "item_id bigint, rank int, doc_id bigint, score bigint")
    return empty if out is None else out
