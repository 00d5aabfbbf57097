"""Exact top-k search by inner product with a pivot table.

Vectors become integers, floor(256 x). Inner products turn into distances: a candidate x lies at (x, sqrt(M^2 - |x|^2)) with M the largest
norm of its cell and a query q at (q, 0), so that |q - x|^2 = |q|^2 + M^2 - 2 q.x. Distances from candidates and queries to the pivots are
computed once. For a query the largest |d(q, p) - d(x, p)| over all pivots bounds the distance from below and so the score from above;
candidates are scored in the order of that bound until the next one cannot reach the k-th score found so far.

Candidates are dealt to cells by their nearest centre, and a cell's rows to blocks of a bounded size. A query first looks into its own cell;
the k-th score found there and the range of pivot distances of each other cell tell which cells it must visit as well. So a block meets chunks
of queries, each in a task of its own, and nothing but centres, pivots and the ranges of at most MAX_CELLS cells comes to the driver.
Centres and pivots come from a bounded sample (`sample` vectors, by a hash); all vectors are candidates, and the result is exact whatever the sample.

Defined results: vectors that are null or hold null, NaN or infinite components take no part; vectors of different lengths have no inner
product and never meet; an empty vector scores 0 with other empty ones. Rows that share an id, or repeat each other, are rows of their own:
each may be found, and each is a query of its own if its id is one. A null id is never a query and sorts last in ties. Scores
outside 64 bits count as the nearest 64-bit number. An empty table gives no rows; other columns do not matter, whatever their names.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import materialize, plain

#: Numbers in a block of candidates and in a chunk of queries: 16,384 rows of 64 numbers.
BLOCK_NUMBERS = 1 << 20
#: Cells, at most; a cell may have many blocks.
MAX_CELLS = 1024
PIVOTS = 16
#: Rows that are scored at first, and the growth of the next runs.
FIRST_RUN, GROWTH = 64, 8
#: Norms from which doubles no longer hold products exactly; bounds are not computed for larger ones.
EXACT = 2.0**53
_FOUND = pa.schema([("query_row", pa.int64()), ("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.int64())])
FOUND = "query_row bigint, query_id bigint, vec_id bigint, score bigint"


class Layout:
    """Centres of cells and pivots for each length of vector, from a sample."""

    def __init__(self, sample: list[np.ndarray], cells: int):
        by_length: dict[int, list[np.ndarray]] = {}
        for v in sample:
            by_length.setdefault(len(v), []).append(v)
        self.of: dict[int, tuple[int, np.ndarray, np.ndarray]] = {}  # length -> first cell, centres, pivots
        self.cells = 0
        for length, rows in sorted(by_length.items()):
            some = np.unique(np.stack(rows), axis=0) if length else np.zeros((1, 0))
            n = min(len(some), max(1, cells * len(rows) // len(sample)))
            far = farthest(some, max(n, min(PIVOTS, len(some))))
            self.of[length] = (self.cells, some[far[:n]], some[far[:PIVOTS]])
            self.cells += n

    def place(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The cell of each row, and its inner products with the pivots. A length that no sampled row has gets a cell of its own without pivots."""
        length = rows.shape[1]
        if length not in self.of:
            return np.full(len(rows), -1 - length, np.int64), np.zeros((len(rows), 0))
        first, centres, pivots = self.of[length]
        with np.errstate(over="ignore", invalid="ignore"):
            apart = (centres**2).sum(1) - 2 * (rows @ centres.T)
        return first + np.nan_to_num(apart, nan=0.0).argmin(1), rows @ pivots.T


def whole(components: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        return np.nan_to_num(np.floor(256 * components))


def farthest(rows: np.ndarray, n: int) -> np.ndarray:
    """n rows, each as far as can be from those chosen before it."""
    with np.errstate(over="ignore", invalid="ignore"):
        chosen = [0]
        away = ((rows - rows[0]) ** 2).sum(1)
        while len(chosen) < n:
            chosen.append(int(away.argmax()))
            away = np.minimum(away, ((rows - rows[chosen[-1]]) ** 2).sum(1))
    return np.array(chosen)


def by_length(column: pa.Array):
    """(places, matrix) for each length among the vectors, given as bytes of doubles."""
    at = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int32)
    size = np.diff(at) // 8
    data = np.frombuffer(column.buffers()[2], np.uint8) if column.buffers()[2] is not None else np.zeros(0, np.uint8)
    for length in np.unique(size):
        own = np.flatnonzero(size == length)
        take = at[own][:, None] + np.arange(int(length) * 8)
        yield own, np.ascontiguousarray(data[take]).view(np.float64).reshape(len(own), int(length))


def packed(rows: np.ndarray) -> list[bytes]:
    return [r.tobytes() for r in np.ascontiguousarray(rows)]


def exact_scores(rows: np.ndarray, query: np.ndarray, small: bool) -> np.ndarray:
    """Inner products as 64-bit integers. small: doubles hold all of them exactly."""
    if small:
        return (rows @ query).astype(np.int64)
    q = [int(x) for x in query]
    least, most = -(1 << 63), (1 << 63) - 1
    return np.array([min(max(sum(int(a) * b for a, b in zip(r, q, strict=True)), least), most) for r in rows], np.int64)


class Block:
    """The candidates of a block with their distances to the pivots."""

    def __init__(self, rows: np.ndarray, ids: np.ndarray, unknown: np.ndarray, keys: np.ndarray, pivots: np.ndarray, dots: np.ndarray, norm: float):
        """unknown: whether the id is null; keys: of rows; dots: inner products with the pivots; norm: the cell's largest."""
        self.rows, self.ids, self.unknown, self.keys, self.pivots, self.norm = rows, ids, unknown, keys, pivots, norm
        self.bounded = len(pivots) > 0 and norm < 2.0**26
        self.own2 = (pivots**2).sum(1) if self.bounded else None
        if self.bounded:
            self.away = np.ascontiguousarray(np.sqrt(np.maximum(norm**2 + self.own2 - 2 * dots, 0)).T.astype(np.float32))
            self.widest = float(self.away.max(initial=0))
        self.scored = 0

    def limits(self, query: np.ndarray) -> np.ndarray:
        """The most that each candidate can score, by the pivot that tells most."""
        size = float(query @ query)
        if not self.bounded or size >= 2.0**52:
            return np.full(len(self.rows), np.inf)
        to = np.sqrt(np.maximum(size + self.own2 - 2 * (self.pivots @ query), 0)).astype(np.float32)
        gap = np.abs(self.away[0] - to[0])
        for i in range(1, len(to)):
            np.maximum(gap, np.abs(self.away[i] - to[i]), out=gap)
        slack = 1e-6 * (self.widest + float(to.max()) + 1)  # what rounding to 32 bits can add
        return (size + self.norm**2 - np.maximum(gap.astype(np.float64) - slack, 0) ** 2) / 2 + 1e-9 * (size + self.norm**2) + 1

    def best(self, query: np.ndarray, key: int, least: float, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Places and scores of the k best, of those that reach `least`."""
        limit = self.limits(query)
        if abs(least) >= EXACT and np.isfinite(least):
            least -= abs(least) * 1e-12  # a score that a double rounds
        small = np.sqrt(float(query @ query)) * self.norm < EXACT
        left = np.flatnonzero(limit >= least)
        places, scores, run = np.zeros(0, np.int64), np.zeros(0, np.int64), FIRST_RUN
        while len(left):
            if run < len(left):  # the next run in the order of the limits
                split = np.argpartition(-limit[left], run)
                now, left = left[split[:run]], left[split[run:]]
            else:
                now, left = left, left[:0]
            self.scored += len(now)
            got = exact_scores(self.rows[now], query, small)
            good = (got >= least) & (self.keys[now] != key)
            places, scores = np.append(places, now[good]), np.append(scores, got[good])
            if len(places) >= k:
                order = np.lexsort((self.ids[places], self.unknown[places], ~scores))[:k]  # ~s falls as s rises
                places, scores = places[order], scores[order]
                least = max(least, float(scores[-1]) if small else -np.inf)
                left = left[limit[left] >= least]
            run *= GROWTH
        return places, scores


def nearest(vectors: DataFrame, id_col: str, vec_col: str, is_query: Column, k: int = 5, sample: int = 4096, block_numbers: int = BLOCK_NUMBERS) -> DataFrame:
    """(query_id, rank, vec_id, score): the k best of all other rows for each row that is_query (of `id`) tells."""
    own, id_, vec = plain(vectors, id_col, vec_col)
    number = F.transform(vec, lambda x: x.cast("double"))
    sound = F.coalesce(F.forall(number, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))), F.lit(False))
    rows = own.where(sound).select(id_.cast("bigint").alias("id"), number.alias("v"))
    some = rows.orderBy(F.xxhash64("id", "v"), "id").select("v").limit(sample).collect()
    sizes = rows.agg(F.count(F.lit(1)).alias("n"), F.max(F.size("v")).alias("width")).first()
    each = max(1, block_numbers // max(1, sizes["width"] or 1))  # rows in a block
    layout = Layout([whole(np.array(r["v"], np.float64)) for r in some], int(min(MAX_CELLS, sizes["n"] // each + 1)))

    def place(batches):
        for b in batches:
            lists = b.column(1)
            flat = whole(lists.flatten().to_numpy(zero_copy_only=False))
            at = np.concatenate(([0], np.cumsum(lists.value_lengths().to_numpy(zero_copy_only=False)))).astype(np.int64)
            for length in np.unique(np.diff(at)):
                here = np.flatnonzero(np.diff(at) == length)
                m = flat[at[here][:, None] + np.arange(int(length))]
                cell, dots = layout.place(m)
                with np.errstate(over="ignore"):
                    norm = np.sqrt((m**2).sum(1))
                columns = [b.column(0).take(pa.array(here)), pa.array(packed(m), pa.binary()), pa.array(cell, pa.int64()), pa.array(norm), pa.array(list(dots), pa.list_(pa.float64()))]
                yield pa.RecordBatch.from_arrays(columns, names=["id", "v", "cell", "norm", "dots"])

    placed = rows.mapInArrow(place, "id bigint, v binary, cell bigint, norm double, dots array<double>")
    placed = materialize(placed.withColumn("row", F.monotonically_increasing_id()), "vectors")

    ends = [f(F.try_element_at("dots", F.lit(i + 1))).alias(f"{f.__name__}{i}") for i in range(PIVOTS) for f in (F.min, F.max)]
    told = placed.where("cell >= 0").groupBy("cell").agg(F.count(F.lit(1)).alias("n"), F.max("norm").alias("norm"), *ends).collect()  # MAX_CELLS rows and PIVOTS at most
    cells = {r["cell"]: r for r in told}
    parts = {c: r["n"] // each + 1 for c, r in cells.items()}
    rare = sizes["n"] // max(1, sample) // each + 1  # blocks of a length that the sample lacks
    norms = {c: r["norm"] for c, r in cells.items()}
    asked = placed.where(is_query)
    chunks = asked.count() // each + 1
    n_parts = F.coalesce(F.try_element_at(F.create_map(*[F.lit(int(x)) for p in parts.items() for x in p]), F.col("cell")), F.lit(rare)) if parts else F.lit(rare)
    blocks = placed.withColumn("part", F.pmod("row", n_parts)).withColumn("chunk", F.explode(F.sequence(F.lit(0), F.lit(chunks - 1))))

    def look(table: pa.Table, queries: pa.Table) -> pa.Table:
        if not len(table) or not len(queries):
            return _FOUND.empty_table()
        (_, m), = by_length(table.column("v").combine_chunks())
        (_, q), = by_length(queries.column("v").combine_chunks())
        cell = table.column("cell")[0].as_py()
        pivots = layout.of[m.shape[1]][2] if m.shape[1] in layout.of else np.zeros((0, m.shape[1]))
        dots = table.column("dots").combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(len(m), -1)
        ids = table.column("id").combine_chunks()
        own_norm = norms.get(cell, float(table.column("norm").to_numpy().max()))
        block = Block(m, ids.fill_null(0).to_numpy(), ids.is_null().to_numpy(zero_copy_only=False), table.column("row").to_numpy(), pivots, dots, own_norm)
        out: list[list] = [[], [], [], []]
        for i, (key, name, least) in enumerate(zip(queries.column("row").to_pylist(), queries.column("id").to_pylist(), queries.column("least").to_pylist(), strict=True)):
            places, scores = block.best(q[i], key, -np.inf if least is None else float(least), k)
            out[0] += [key] * len(places)
            out[1] += [name] * len(places)
            out[2] += ids.take(pa.array(places)).to_pylist()
            out[3] += scores.tolist()
        return pa.Table.from_arrays([pa.array(x, pa.int64()) for x in out], schema=_FOUND)

    def visit(queries: DataFrame) -> DataFrame:
        """queries: (row, id, v, least, cell)"""
        each_part = queries.withColumn("part", F.explode(F.sequence(F.lit(0).cast("bigint"), (n_parts - 1).cast("bigint")))).withColumn("chunk", F.pmod("row", F.lit(chunks)).cast("int"))
        keys = ["cell", "part", "chunk"]
        return blocks.groupBy(*keys).cogroup(each_part.groupBy(*keys)).applyInArrow(look, FOUND)

    def top(found: DataFrame) -> DataFrame:
        w = W.partitionBy("query_row").orderBy(F.desc("score"), F.asc_nulls_last("vec_id"))
        return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)

    home = materialize(top(visit(asked.select("row", "id", "v", F.lit(None).cast("bigint").alias("least"), "cell"))), "home")
    known = home.groupBy("query_row").agg(F.min("score").alias("least"), F.count(F.lit(1)).alias("n_found"))
    known = known.select(F.col("query_row").alias("row"), F.when(F.col("n_found") >= k, F.col("least")).alias("least"))

    def others(batches):
        """A row for each other cell that may hold a better candidate, by the ranges of its pivot distances."""
        for b in batches:
            for here, q in by_length(b.column(2)):
                if q.shape[1] not in layout.of:
                    continue
                first, centres, pivots = layout.of[q.shape[1]]
                near = [c for c in range(first, first + len(centres)) if c in cells]
                rows_, cells_ = [], []
                size = (q**2).sum(1)
                least = np.array([-np.inf if x is None else float(x) for x in b.column(3).take(pa.array(here)).to_pylist()])
                home_cell = b.column(4).take(pa.array(here)).to_numpy()
                own2 = (pivots**2).sum(1)
                with np.errstate(over="ignore", invalid="ignore"):
                    to = np.sqrt(np.maximum(size[:, None] + own2 - 2 * q @ pivots.T, 0))
                for c in near:
                    r = cells[c]
                    dots = np.array([[r[f"min{i}"], r[f"max{i}"]] for i in range(len(pivots))], np.float64)
                    with np.errstate(over="ignore", invalid="ignore"):
                        low, high = np.sqrt(np.maximum(r["norm"] ** 2 + own2 - 2 * dots[:, 1], 0)), np.sqrt(np.maximum(r["norm"] ** 2 + own2 - 2 * dots[:, 0], 0))
                        gap = np.maximum(np.maximum(low - to, to - high), 0).max(1)
                        limit = (size + r["norm"] ** 2 - (gap * (1 - 1e-9)) ** 2) / 2 + 1e-9 * (size + r["norm"] ** 2) + 1
                    go = (home_cell != c) & ((limit >= least) | ~np.isfinite(limit) | (max(r["norm"], 1.0) * np.sqrt(size) >= 2.0**52))
                    rows_.append(here[go])
                    cells_.append(np.full(int(go.sum()), c, np.int64))
                at = np.concatenate(rows_) if rows_ else np.zeros(0, np.int64)
                picked = pa.RecordBatch.from_arrays([b.column(i).take(pa.array(at)) for i in range(4)] + [pa.array(np.concatenate(cells_) if cells_ else at, pa.int64())], names=["row", "id", "v", "least", "cell"])
                yield picked

    going = asked.join(known, "row", "left").select("row", "id", "v", "least", "cell").mapInArrow(others, "row bigint, id bigint, v binary, least bigint, cell bigint")
    away = visit(going)
    both = home.select("query_row", "query_id", "vec_id", "score").unionByName(away)
    return top(both).select("query_id", "rank", "vec_id", "score")
