"""Near-duplicates by ProbMinHash, banding and verification.

Shingles are runs of five words (all words of a shorter text), weighted by 1 + log2 of how often they occur. Every
shingle emits a Poisson process of arrivals at its weight's rate, each at a random component of the signature; a component keeps its
earliest arrival, and a process ends once it is later than all components, so most shingles stop after one or two
arrivals. Components of two documents agree with the probability of their probability Jaccard index. Bands of
components propose pairs; every link is then verified by the exact Jaccard similarity of the shingle sets. A text with repeated
shingles also emits the bands of the same process with all weights 1. There the probability Jaccard index is that of the sets, so
a pair is proposed by the measure that verifies it, however unequally its shingles repeat; other texts have these bands already.

Texts with the same words collapse into one first (64-bit names, told apart by 64 further bits), so groups of copies stay out of the pairs. In each band's
bucket all members are compared with the smallest id; verified links give components. Buckets whose
members still lie in several components go, with equal buckets taken once, to tasks that compare their members across
components all with all and return a spanning set of the links found. A bucket of more than CHUNK such members is split into chunks of
that size, and each pair of chunks is a task: no link between members of a bucket is lost and no task grows, but n members of a bucket that the
first round leaves apart are sent n / CHUNK times each.

Defined results: a null, empty or blank text has no shingles; such texts have the same words and form one class; a null id
counts as larger than all others; repeated rows share a class; `drop_near` keeps one row of each class, that with the smallest
id and, among rows of one id (null ids are alike), the smallest hash of its words; an empty table gives an empty result; extra columns pass through `drop_near`.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import SPACE, free_shuffles, id_key, materialize, mix64, named_as, plain, text_of
from .components import components
from .words import Words, slices

SHINGLE = 5
BANDS, ROWS = 24, 5
#: Members of a bucket that one task compares.
CHUNK = 500
#: Shingles whose arrivals are drawn at a time.
RUN = 1 << 20
_STEP = np.uint64(0x9E3779B97F4A7C15)
_MUL = (np.uint64(0x9FB21C651E98DF25), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9), np.uint64(0x27D4EB2F165667C5), np.uint64(0x85EBCA77C2B2AE63))


def shingles(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """By distinct shingle of each text, in order of text and hash: text, hash, occurrences."""
    w = Words(texts)
    x = w.hashes()
    n = np.where(w.count >= SHINGLE, w.count - SHINGLE + 1, (w.count > 0).astype(np.int64))
    if len(n) == 1:  # one text, perhaps a very long one
        value = np.zeros(int(n[0]), np.uint64)
        size = min(len(x), SHINGLE)
        for k in range(size):
            value += x[k : k + len(value)] * _MUL[k]
        value = mix64(value + np.uint64(size))
        value.sort()
        new = np.ones(len(value), bool)
        new[1:] = value[1:] != value[:-1]
        at = np.flatnonzero(new)
        return np.zeros(len(at), np.int32), value[at], np.diff(np.append(at, len(value)))
    doc = np.repeat(np.arange(len(n), dtype=np.int32), n)
    start = np.repeat(w.first[:-1] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
    size = np.minimum(w.count, SHINGLE)[doc]
    value = np.zeros(len(doc), np.uint64)
    for k in range(SHINGLE):
        here = size > k
        value[here] += x[start[here] + k] * _MUL[k]
    value = mix64(value + size.astype(np.uint64))
    order = np.lexsort((value, doc))
    doc, value = doc[order], value[order]
    new = np.ones(len(doc), bool)
    new[1:] = (doc[1:] != doc[:-1]) | (value[1:] != value[:-1])
    at = np.flatnonzero(new)
    return doc[at], value[at], np.diff(np.append(at, len(doc)))


def signatures(doc: np.ndarray, value: np.ndarray, count: np.ndarray, n: int, m: int = BANDS * ROWS) -> np.ndarray:
    """n x m components: the low 32 bits of the shingle that arrives first."""
    best = np.full(n * m, np.uint64(0xFFFFFFFF) << np.uint64(32))
    for a in range(0, len(doc), RUN):  # the least of all runs is the least of all
        _arrive(best, doc[a : a + RUN], value[a : a + RUN], count[a : a + RUN], n, m)
    return (best & np.uint64(0xFFFFFFFF)).reshape(n, m)


def _arrive(best: np.ndarray, doc: np.ndarray, value: np.ndarray, count: np.ndarray, n: int, m: int) -> None:
    weight = 1 + np.log2(count)
    time, seed, own, name = np.zeros(len(doc)), value.copy(), doc.astype(np.int64), value & np.uint64(0xFFFFFFFF)
    while len(own):
        seed += _STEP
        r = mix64(seed)
        unit = ((r >> np.uint64(32)).astype(np.float64) + 1) / 2.0**32
        time = time - np.log(unit) / weight
        at = own * m + ((r & np.uint64(0xFFFFFFFF)) * np.uint64(m) >> np.uint64(32)).astype(np.int64)
        key = (time.astype(np.float32).view(np.uint32).astype(np.uint64) << np.uint64(32)) | name
        np.minimum.at(best, at, key)
        # the latest component of each document that still has arrivals
        left = np.unique(own)
        latest = np.zeros(n, np.uint64)
        latest[left] = best.reshape(n, m)[left].max(1)
        stay = key < latest[own]
        time, seed, own, name, weight = time[stay], seed[stay], own[stay], name[stay], weight[stay]


def bands(signature: np.ndarray) -> np.ndarray:
    """n x BANDS keys."""
    out = np.zeros((len(signature), BANDS), np.uint64)
    for b in range(BANDS):
        key = np.full(len(signature), b + 1, np.uint64)
        for r in range(ROWS):
            key = mix64(key * _MUL[1] + signature[:, b * ROWS + r])
        out[:, b] = key
    return out


def proposals(doc: np.ndarray, value: np.ndarray, count: np.ndarray, n: int):
    """(documents, their band keys): by sets for all n documents, and by weights for those that repeat a shingle."""
    yield np.arange(n), bands(signatures(doc, value, np.ones_like(count), n))
    repeats = np.unique(doc[count > 1])
    if len(repeats):
        own = np.isin(doc, repeats)
        yield repeats, bands(signatures(np.searchsorted(repeats, doc[own]), value[own], count[own], len(repeats)))


def _keys(rows: DataFrame) -> DataFrame:
    """(id, bucket) of every text with a shingle."""

    def run(batches):
        for batch in batches:
            for first, part in slices(batch.column(1), 2 << 20):
                doc, value, count = shingles(part)
                some = np.unique(doc)
                if not len(some):
                    continue
                for own, key in proposals(np.searchsorted(some, doc), value, count, len(some)):
                    ids = batch.column(0).take(pa.array(np.repeat(some[own] + first, key.shape[1])))
                    yield pa.RecordBatch.from_arrays([ids, pa.array(key.reshape(-1).view(np.int64))], names=["id", "bucket"])

    return rows.select("id", "text").mapInArrow(run, "id bigint, bucket bigint")


def _sets(rows: DataFrame) -> DataFrame:
    """(id, n, hashes): the shingle set, sorted, as bytes."""

    def run(batches):
        for batch in batches:
            for first, part in slices(batch.column(1)):
                doc, value, _ = shingles(part)
                ends = np.searchsorted(doc, np.arange(len(part) + 1))
                data = [value[a:b].tobytes() for a, b in zip(ends, ends[1:], strict=False)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, len(part)), pa.array(data, pa.binary())], names=["id", "hashes"])

    return rows.select("id", "text").mapInArrow(run, "id bigint, hashes binary")


def _similar(a: bytes, b: bytes, least: float) -> bool:
    x, y = np.frombuffer(a, np.uint64), np.frombuffer(b, np.uint64)
    if min(len(x), len(y)) < least * max(len(x), len(y)):
        return False
    both = len(x) + len(y) - len(np.union1d(x, y))
    return both >= least * (len(x) + len(y) - both) and both > 0


def _verified(pairs: DataFrame, sets: DataFrame, least: float) -> DataFrame:
    """The pairs (a, b) whose sets are similar."""
    x = sets.select(F.col("id").alias("a"), F.col("hashes").alias("x"))
    y = sets.select(F.col("id").alias("b"), F.col("hashes").alias("y"))

    def run(batches):
        for batch in batches:
            x, y = batch.column(2).to_pylist(), batch.column(3).to_pylist()
            keep = np.array([_similar(p, q, least) for p, q in zip(x, y, strict=True)], bool)
            yield batch.filter(pa.array(keep)).select([0, 1])

    return pairs.join(x, "a").join(y, "b").select("a", "b", "x", "y").mapInArrow(run, "a bigint, b bigint")


def _links(ids: np.ndarray, parts: np.ndarray, sets: list[np.ndarray], left: np.ndarray, least: float) -> list[tuple[int, int]]:
    """A spanning set of the links between members of different parts; left: members that all others meet."""
    n = len(ids)
    names, inverse, seen = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    owner = np.repeat(np.arange(n), [len(s) for s in sets])
    shared = seen[inverse] > 1  # a hash that one member has cannot be common to two
    owner, inverse = owner[shared], inverse[shared]
    new = np.cumsum(seen > 1) - 1
    column = new[inverse]
    size = np.array([len(s) for s in sets])
    root = {int(p): int(p) for p in parts}

    def top(p: int) -> int:
        while root[p] != p:
            root[p] = root[root[p]]
            p = root[p]
        return p

    common = np.zeros((int(left.sum()), n), np.float32)
    rows = np.flatnonzero(left)
    width = 4096
    order = np.argsort(column, kind="stable")
    owner, column = owner[order], column[order]
    edges = np.searchsorted(column, np.arange(0, len(names) + width, width))
    for k, (a, b) in enumerate(zip(edges, edges[1:], strict=False)):
        if a < b:
            dense = np.zeros((n, width), np.float32)
            dense[owner[a:b], column[a:b] - k * width] = 1
            common += dense[rows] @ dense.T
    out = []
    for i, row in enumerate(rows):
        both = common[i].astype(np.float64)
        for j in np.flatnonzero((both > 0) & (both >= least * (size[row] + size - both)) & (parts != parts[row])):
            p, q = top(int(parts[row])), top(int(parts[j]))
            if p != q:
                root[max(p, q)] = min(p, q)
                out.append((int(ids[row]), int(ids[j])))
    return out


def _rest(keys: DataFrame, parts: DataFrame, sets: DataFrame, least: float) -> DataFrame:
    """Links (a, b) across the parts of buckets that the first round left apart."""
    named = keys.join(parts, "id", "left").select("id", "bucket", F.coalesce("component", "id").alias("part"))
    apart = named.groupBy("bucket").agg(F.min("part").alias("p"), F.max("part").alias("q"), F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("id").cast("decimal(38,0)")).alias("s"), F.min("id").alias("lo"), F.max("id").alias("hi"))
    apart = apart.where("p < q").groupBy("n", "s", "lo", "hi").agg(F.min("bucket").alias("bucket"))  # buckets of the same members are one
    chunks = F.ceil(F.col("n") / CHUNK).cast("int")
    rest = materialize(named.join(apart.select("bucket", chunks.alias("chunks")), "bucket"), "apart")
    # Each pair of chunks is a task (i <= j); a member goes to those with its own chunk.
    own = F.pmod(F.xxhash64("id"), F.col("chunks")).cast("int")
    dealt = rest.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
    dealt = dealt.select("id", "part", "own", "bucket", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j")).join(sets, "id")

    def compare(table: pa.Table) -> pa.Table:
        ids, part = table.column("id").to_numpy(), table.column("part").to_numpy()
        left = table.column("own").to_numpy() == table.column("i")[0].as_py()
        found = _links(ids, part, [np.frombuffer(x, np.uint64) for x in table.column("hashes").to_pylist()], left, least)
        return pa.Table.from_arrays([pa.array([x for x, _ in found], pa.int64()), pa.array([x for _, x in found], pa.int64())], names=["a", "b"])

    return dealt.groupBy("bucket", "i", "j").applyInArrow(compare, "a bigint, b bigint").distinct()


def _text(text: Column) -> Column:
    """Words with one space between them."""
    return F.trim(F.regexp_replace(text_of(text), SPACE, " "))


def _rows(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    own, id_, text = plain(docs, id_col, text_col)
    return own.select(id_.cast("bigint").alias("doc"), _text(text).alias("text"))


class Names:
    """64-bit names of word sequences, no two of which share one: a second hash of 64 bits tells where texts would, and those get other names."""

    def __init__(self, first=lambda text: F.xxhash64(text)):
        self.first = first
        self.again: list[list[int]] = []

    def of(self, text: Column) -> Column:
        name = self.first(text)
        for turn, clash in enumerate(self.again):
            name = F.when(name.isin(clash), F.xxhash64(F.lit(turn), text)).otherwise(name)
        return name

    def settle(self, docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
        """(id, copy_of, n) of each word sequence: its name, the smallest id that has it and how many rows do.

        Among n texts n * n / 2 ** 65 pairs clash: about 3 among 1e10, so their names fit on the driver.
        """
        while True:
            rows = _rows(docs, id_col, text_col).select("doc", self.of(F.col("text")).alias("id"), F.xxhash64(F.lit("check"), "text").alias("check"))
            texts = materialize(rows.groupBy("id").agg(F.min("doc").alias("copy_of"), F.count(F.lit(1)).alias("n"), F.min("check").alias("lo"), F.max("check").alias("hi")), "texts")
            clash = [r["id"] for r in texts.where("lo <> hi").select("id").collect()]
            if not clash:
                return texts.drop("lo", "hi")
            self.again.append(clash)


def classes(docs: DataFrame, similarity: float = 0.8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row for each document: id, copy_of (smallest id with the same words), class_id (smallest id of its class), class_size."""
    return _classes(docs, Names(), similarity, id_col, text_col).select("id", "copy_of", "class_id", "class_size")


def _classes(docs: DataFrame, names: Names, similarity: float, id_col: str, text_col: str) -> DataFrame:
    """`classes` with the name of the document's words, and of the words that stand for its class: words, class_words."""
    spark = docs.sparkSession
    texts = names.settle(docs, id_col, text_col)
    rows = _rows(docs, id_col, text_col).withColumn("id", names.of(F.col("text")))
    one = materialize(rows.select("id", "text").dropDuplicates(["id"]), "distinct_texts")
    free_shuffles(spark)
    keys = materialize(_keys(one), "buckets")
    free_shuffles(spark)
    n = BANDS * texts.count()
    hubs = keys.groupBy("bucket").agg(F.min("id").alias("a"), F.count(F.lit(1)).alias("n")).where("n > 1").select("bucket", "a")
    shared = materialize(keys.join(hubs, "bucket").select("bucket", "id", "a"), "shared_buckets", rows=n)
    wanted = shared.select("id").distinct()
    sets = materialize(_sets(one.join(wanted, "id", "left_semi")), "shingle_sets")
    free_shuffles(spark)
    pairs = shared.where("id <> a").select("a", F.col("id").alias("b")).distinct()
    links = materialize(_verified(pairs, sets, similarity), "links")
    parts = components(links, "first")
    more = materialize(_rest(shared.select("id", "bucket"), parts, sets, similarity), "more_links")
    found = parts if more.isEmpty() else components(links.unionByName(more), "all")
    named = texts.join(found, "id", "left").withColumn("component", F.coalesce("component", "id"))
    first = F.min(F.struct(F.col("copy_of").isNull(), "copy_of", "id"))  # null ids last
    whole = named.groupBy("component").agg(first.alias("first"), F.sum("n").alias("class_size"))
    named = named.join(whole, "component").select("id", "copy_of", F.col("first")["copy_of"].alias("class_id"), "class_size", F.col("first")["id"].alias("class_words"))
    return rows.select("doc", "id").join(named, "id").select(F.col("doc").alias("id"), "copy_of", "class_id", "class_size", F.col("id").alias("words"), "class_words")


def drop_near(docs: DataFrame, similarity: float = 0.8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One document of each class, that with the smallest id and hash of its words, with all its columns."""
    names = Names()
    found = _classes(docs, names, similarity, id_col, text_col).where((F.col("id").eqNullSafe(F.col("class_id"))) & (F.col("words") == F.col("class_words")))
    stay = found.select(id_key(F.col("id")).alias("key"), "words").distinct()
    # the window stands on the join's partitioning: texts are dealt out once here
    own, id_, text = plain(docs, id_col, text_col)
    own = own.withColumn("key", id_key(id_.cast("bigint"))).withColumn("words", names.of(_text(text))).join(stay, ["key", "words"], "left_semi")
    first = F.row_number().over(W.partitionBy("key", "words").orderBy(F.lit(1)))  # rows that repeat id and words
    return named_as(own.withColumn("row", first).where("row = 1"), docs)
