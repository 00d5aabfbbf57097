"""Mixing sources to target weights with a multivariate-hypergeometric splitting tree.

Each source's documents stand in an order permuted by a seeded hash, as one stream of words; a block is the whole documents that
begin in the same `block_words` words of it, so no block cuts a document. A source's target in words gives its quota of blocks: whole
passes over its blocks, then blocks of a further pass, each pass in its own permuted order; of the last block drawn only as many
words are taken as the target has left. A splitting tree deals the quotas to output shards: a node that holds so many blocks
of each source draws its left child's share of the total from the multivariate hypergeometric law, down to the shards. A
shard draws, of each source, the next blocks of the permuted order, as many as its leaf says and none twice; the documents drawn
are then shuffled inside the shard by a seeded hash. `Mix.pieces` gives each piece its shard and its position there, and `mixed`
writes a partition for each shard in that order.

Targets: sources by code point, null last, weigh by `weights` in turn and share `share` of all words; none gets
more than `most` times its own words, and the excess is shared again by weight until none is above.

Bounds: one row for each source comes to the driver (`MAX_SOURCES` at most, else an error), and the tree's leaves
are sources x shards, one shard for each `shard_words` words. Ranks and running sums are made in buckets of a bounded size.

Defined results: a null or blank text has size 0 and is never drawn; rows of one id are ordered by their text's hash; rows that
agree in source, id and text are drawn each for itself, and `mixed` gives them the columns of one of them; a null id is permitted; an
empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import SPACE, WORD, id_key, materialize, named_as, plain, text_of

MAX_SOURCES = 100_000
#: Rows that a bucket of a permuted order holds on average.
BUCKET = 100_000
#: Words of a shard.
SHARD_WORDS = 4_000_000


def targets(sizes: list[int], weights: tuple[float, ...] = (5, 2, 1), share: float = 1.5, most: float = 2.0) -> list[float]:
    """Words to take from each source (in order), with the excess over `most` times its size shared again."""
    w = [float(weights[i % len(weights)]) for i in range(len(sizes))]
    cap = [most * s for s in sizes]
    out = [0.0] * len(sizes)
    free, left = set(range(len(sizes))), share * sum(sizes)
    while free:
        total = sum(w[i] for i in free)
        for i in free:
            out[i] = left * w[i] / total
        over = [i for i in free if out[i] > cap[i]]
        if not over:
            break
        for i in over:
            out[i] = cap[i]
            left -= cap[i]
            free.discard(i)
    return out


def _some_of(counts: np.ndarray, n: int, rng: np.random.Generator) -> np.ndarray:
    """How many of each kind are among n drawn without replacement. Beyond the sampler's limit the draw is made of equal parts."""
    if counts.sum() < 1_000_000_000:
        return rng.multivariate_hypergeometric(counts, n, method="marginals")
    half = counts // 2
    first = n * int(half.sum()) // int(counts.sum())
    return _some_of(half, first, rng) + _some_of(counts - half, n - first, rng)


def split(quotas: np.ndarray, shards: int, rng: np.random.Generator) -> np.ndarray:
    """Quotas of each shard (shards x sources). The tree halves the shards; blocks follow in proportion."""
    if shards == 1:
        return quotas[None, :]
    left = shards // 2
    share = int(quotas.sum()) * left // shards
    mine = _some_of(quotas, share, rng) if len(quotas) else quotas
    return np.concatenate((split(mine, left, rng), split(quotas - mine, shards - left, rng)))


def _row(id_: Column, text: Column) -> Column:
    """The text's hash tells apart rows that share an id."""
    return F.xxhash64(id_.cast("bigint"), text_of(text))


def _unit(value: Column) -> Column:
    """A 64-bit hash as a number from 0 to 1."""
    return value / F.lit(2.0**64) + 0.5


def _running(rows: DataFrame, by: list[str], order: str, ties: list[str], buckets: int, sums: dict[str, Column]) -> DataFrame:
    """Sums over all rows of a group that come before a row in the order of a hash; no group has to meet in one task.

    The hash's range is cut into buckets: their totals run ahead, and a window inside each does the rest.
    """
    rows = rows.withColumn("__b", F.least(F.floor(_unit(F.col(order)) * buckets), F.lit(buckets - 1)).cast("bigint"))
    total = rows.groupBy(*by, "__b").agg(*[F.sum(c).alias(f"__t_{k}") for k, c in sums.items()])
    ahead = W.partitionBy(*by).orderBy("__b").rowsBetween(W.unboundedPreceding, -1)  # as many rows as there are buckets
    zero = F.lit(0).cast("bigint")
    total = total.select(*by, "__b", *[F.coalesce(F.sum(f"__t_{k}").over(ahead), zero).alias(f"__t_{k}") for k in sums])
    inside = W.partitionBy(*by, "__b").orderBy(order, *ties).rowsBetween(W.unboundedPreceding, -1)
    rows = rows.withColumns({f"__i_{k}": F.coalesce(F.sum(c).over(inside), zero) for k, c in sums.items()}).join(total, [*by, "__b"])
    return rows.withColumns({k: F.col(f"__t_{k}") + F.col(f"__i_{k}") for k in sums}).drop("__b", *[f"__{x}_{k}" for k in sums for x in "ti"])


class Mix:
    """A plan over one corpus: `documents` (sizes and targets) and `pieces` (what each shard takes, and where it stands there)."""

    def __init__(self, docs: DataFrame, weights=(5, 2, 1), share=1.5, most=2.0, shards=None, block_words=256, shard_words=SHARD_WORDS, seed=20240, id_col="doc_id", text_col="text", source_col="source"):
        spark = docs.sparkSession
        own, source, id_, text = plain(docs, source_col, id_col, text_col)
        size = F.regexp_count(text_of(text), F.lit(WORD)).cast("bigint")
        rows = own.select(source.cast("string").alias("source"), id_key(source).alias("s"), id_.cast("bigint").alias("id"), _row(id_, text).alias("row"), size.alias("size"))
        # rows that agree in all of this are counted first and told apart by a number, so that many of them spread like others
        alike = rows.groupBy("source", "s", "id", "row", "size").agg(F.count(F.lit(1)).alias("copies"))
        alike = materialize(alike, "sizes")
        per = alike.groupBy("source", "s").agg(F.sum(F.col("size") * F.col("copies")).alias("words"), F.sum("copies").alias("n"), F.max("copies").alias("most")).limit(MAX_SOURCES + 1).collect()
        if len(per) > MAX_SOURCES:
            raise ValueError(f"more than {MAX_SOURCES} sources; map them to fewer mixing sources first")
        per.sort(key=lambda r: (r["source"] is None, r["source"] or ""))
        words = [int(r["words"]) for r in per]
        goal = targets(words, weights, share, most)
        take = [min(round(g), int(most * s)) for g, s in zip(goal, words, strict=True)]
        #: at most MAX_SOURCES rows
        self.sources = spark.createDataFrame([(r["s"], w, float(g), t) for r, w, g, t in zip(per, words, goal, take, strict=True)], "s string, words bigint, target double, take bigint")
        self.shards = shards or sum(take) // shard_words + 8
        self.most_copies = max((int(r["most"]) for r in per), default=0)
        plan = F.broadcast(self.sources)
        rows = alike.withColumn("k", F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("copies")))).drop("copies").join(plan, "s", "left")
        rows = rows.withColumn("p", F.xxhash64(F.lit(seed), "row", "k"))
        self.documents = rows.select("source", "s", "id", "row", "k", "size", F.col("words").alias("source_size"), "target")
        many = lambda n: int(n) // BUCKET + 16
        n = sum(int(r["n"]) for r in per)
        stream = _running(rows.where("size > 0 AND take > 0").select("s", "id", "row", "k", "size", "p"), ["s"], "p", ["row", "id", "k"], many(n), {"at": F.col("size")})
        stream = materialize(stream.withColumn("block", F.floor(F.col("at") / block_words)), "streams", rows=n)
        self.stream = stream
        blocks = stream.groupBy("s", "block").agg(F.sum("size").alias("n"), F.min("at").alias("first"))
        passes = F.ceil(F.col("take") / F.col("words")).cast("bigint")  # at most `most`, rounded up
        blocks = blocks.join(plan, "s").withColumn("pass", F.explode(F.sequence(F.lit(0).cast("bigint"), passes - 1)))
        blocks = blocks.withColumn("h", F.xxhash64(F.lit(seed), "s", "pass", "block"))
        # rank: the block's place in the permuted order of its pass; ahead: words before it there
        drawn = _running(blocks, ["s", "pass"], "h", ["block"], many(n), {"rank": F.lit(1), "ahead": F.col("n")})
        left = F.col("take") - F.col("pass") * F.col("words") - F.col("ahead")
        drawn = drawn.withColumn("n", F.least(F.col("n"), left)).where("n > 0")
        drawn = materialize(drawn.select("s", "pass", "block", "first", "n", "rank"), "drawn_blocks", rows=n)
        counts = {(r["s"], r["pass"]): r["n"] for r in drawn.groupBy("s", "pass").agg(F.count(F.lit(1)).alias("n")).collect()}  # as many rows as passes for each source
        passes_of: dict[str, list[int]] = {r["s"]: [] for r in per}
        for (s, _), n in sorted(counts.items()):
            passes_of[s].append(n)
        quotas = np.array([sum(passes_of[r["s"]]) for r in per], np.int64)
        #: by shard and source, the blocks that the tree gives it
        self.leaves = split(quotas, self.shards, np.random.default_rng(seed))
        self.order = [r["s"] for r in per]
        self.pieces = self._pieces(spark, stream, drawn, passes_of, quotas, seed)

    def _pieces(self, spark, stream: DataFrame, drawn: DataFrame, passes_of: dict, quotas: np.ndarray, seed: int) -> DataFrame:
        """s, id, row, k, pass, size, n, shard, position: the first n words of a document, at a position in a shard.

        A slot is a block's number among all those drawn of its source. A leaf owns a run of slots. Slots meet leaves by cells as wide as
        an average leaf, of which a leaf touches few, so a slot sees a few leaves however many shards there are.
        """
        ahead = [(s, p, sum(n[:p])) for s, n in passes_of.items() for p in range(len(n))]
        bases = spark.createDataFrame(ahead, "s string, pass bigint, base bigint")
        stops = np.cumsum(self.leaves, axis=0)
        table = []
        for i, s in enumerate(self.order):
            wide = int(quotas[i]) // self.shards + 1
            for shard in range(self.shards):
                lo, hi = int(stops[shard, i] - self.leaves[shard, i]), int(stops[shard, i])
                if hi > lo:
                    table.append((s, wide, shard, lo, hi))
        leaves = spark.createDataFrame(table, "s string, wide bigint, shard bigint, lo bigint, hi bigint")
        cells = leaves.withColumn("cell", F.explode(F.expr("sequence(lo div wide, (hi - 1) div wide)"))).select("s", "cell", "shard", "lo", "hi")
        wides = leaves.select("s", "wide").distinct()
        slots = drawn.join(F.broadcast(bases), ["s", "pass"]).withColumn("slot", F.col("base") + F.col("rank")).join(F.broadcast(wides), "s")  # both: a few rows for each source
        slots = slots.withColumn("cell", F.expr("slot div wide")).join(cells, ["s", "cell"]).where("slot >= lo AND slot < hi")
        slots = slots.select("s", "block", "pass", "first", F.col("n").alias("quota"), "shard")
        rows = stream.select("s", "block", "id", "row", "k", "size", "at").join(slots, ["s", "block"])
        rows = rows.withColumn("n", F.least(F.col("size"), F.col("quota") - (F.col("at") - F.col("first")))).where("n > 0")
        # the local shuffle: a shard has a bounded number of words
        shuffled = W.partitionBy("shard").orderBy(F.xxhash64(F.lit(seed), "shard", "pass", "row", "k"), "s", "row", "k", "pass")
        return rows.select("s", "id", "row", "k", "pass", "size", "n", "shard", (F.row_number().over(shuffled) - 1).cast("bigint").alias("position"))


def taken(mix: Mix) -> DataFrame:
    """A row for each document: id, source, size, source_size, target, taken, n_shards, places (shard:position:words of each pass, comma-joined)."""
    place = F.struct("pass", F.concat_ws(":", F.col("shard").cast("string"), F.col("position").cast("string"), F.col("n").cast("string")).alias("t"))
    # a document has a place in each pass at most
    sums = mix.pieces.groupBy("s", "id", "row", "k").agg(F.sum("n").alias("taken"), F.count_distinct("shard").alias("n_shards"), F.sort_array(F.collect_list(place)).alias("places"))
    d = mix.documents
    on = (d["s"] == sums["s"]) & d["id"].eqNullSafe(sums["id"]) & (d["row"] == sums["row"]) & (d["k"] == sums["k"])
    zero = F.lit(0).cast("bigint")
    where = F.array_join(F.transform("places", lambda x: x["t"]), ",")
    return d.join(sums, on, "left").select(d["id"], "source", "size", "source_size", "target", F.coalesce("taken", zero).alias("taken"), F.coalesce("n_shards", zero).alias("n_shards"), F.coalesce(where, F.lit("")).alias("places"))


def mixed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **how) -> DataFrame:
    """The mix as documents with the columns of docs: each whole, cut where its source's target ends, or twice, as the shards draw it.

    A partition is a shard, in the order of the local shuffle. `n_chars`, if there, follows the text.
    """
    mix = Mix(docs, id_col=id_col, text_col=text_col, source_col=source_col, **how)
    own, source, id_, text = plain(docs, source_col, id_col, text_col)
    names = own.columns
    own = own.select("*", id_key(source).alias("s"), id_key(id_.cast("bigint")).alias("key"), _row(id_, text).alias("row"))
    pieces = mix.pieces.withColumn("key", id_key(F.col("id"))).select("s", "key", "row", "size", "n", "shard", "position")
    # rows that agree in all of the key stand for each other: the k-th drawn takes any one of them
    if mix.most_copies > 1:
        own = own.groupBy("s", "key", "row").agg(*[F.first(n).alias(n) for n in names])
    j = own.join(pieces, ["s", "key", "row"])
    j = j.repartitionById(mix.shards, F.col("shard").cast("int")).sortWithinPartitions("shard", "position")
    words = F.regexp_extract_all(text, F.lit(f"(?:{SPACE})?{WORD}"), F.lit(0))  # each with the white space before it
    cut = F.when(F.col("size") == F.col("n"), text).otherwise(F.array_join(F.slice(words, F.lit(1), F.col("n").cast("int")), ""))
    changed = {_name(docs, text_col): cut}
    if "n_chars" in docs.columns:
        changed[_name(docs, "n_chars")] = F.length(cut).cast(docs.schema["n_chars"].dataType)
    return named_as(j, docs, **changed)


def _name(docs: DataFrame, column: str) -> str:
    """The plain name of a column."""
    own = docs.columns
    return f"c{own.index(column) if column in own else [c.lower() for c in own].index(column.lower())}"
