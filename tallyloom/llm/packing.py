"""Best-fit packing by minimum bin slack.

Items of one length are alike, so the plan is made over the counts of the lengths (at most `capacity` numbers, whatever
the input). For each bin the longest length left is fixed, and a subset-sum over bitsets finds the fullest
feasible combination of the lengths left. It is removed as often as the counts allow, which uses up a length each time; a
plan thus has at most `capacity` patterns. Documents then take the places of their length by rank; ranks come
from counts of (chunk, length) and a window inside each chunk, so no length has to meet in one task: a length of n pieces has
about sqrt(n) chunks of sqrt(n) pieces. A piece finds its pattern by cells of ranks, of which a part of a pattern covers few.

Defined results: a null text is empty and gives one piece of the end id; repeated rows are packed each; rows with a
null id are packed too; an empty table gives an empty result.
"""

from __future__ import annotations

import zlib
from math import isqrt

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import materialize, plain
from .tokens import encoded


def fullest(counts: list[int], capacity: int, lengths: list[int]) -> list[tuple[int, int]]:
    """The fullest combination with the longest length left: (length, times) in falling order of length.

    lengths: those left, in falling order.
    """
    first = lengths[0]
    room = capacity - first
    reach, mask = 1, (1 << (room + 1)) - 1
    steps: list[tuple[int, int, int]] = []
    for length in lengths:
        if length > room:
            continue
        left = min(counts[length] - (length == first), room // length)
        before, part = reach, 1
        while left > 0:
            take = min(part, left)
            reach |= (reach << (length * take)) & mask
            left -= take
            part *= 2
        if reach != before:
            steps.append((length, before, reach))
        if reach >> room & 1:
            break
    rest = reach.bit_length() - 1
    used = {first: 1}
    for length, before, _ in reversed(steps):
        n = 0
        while not before >> rest & 1:
            rest -= length
            n += 1
        if n:
            used[length] = used.get(length, 0) + n
    return sorted(used.items(), reverse=True)


def plan(counts: dict[int, int], capacity: int) -> list[tuple[list[tuple[int, int]], int]]:
    """Patterns and how many bins each fills. Takes every item once."""
    left = [0] * (capacity + 1)
    for length, n in counts.items():
        left[length] = int(n)
    lengths = [x for x in range(capacity, 0, -1) if left[x]]
    out = []
    while lengths:
        pattern = fullest(left, capacity, lengths)
        times = min(left[length] // n for length, n in pattern)
        for length, n in pattern:
            left[length] -= n * times
        out.append((pattern, times))
        lengths = [x for x in lengths if left[x]]
    return out


def places(patterns: list[tuple[list[tuple[int, int]], int]]) -> list[tuple[int, int, int, int, int, int]]:
    """(length, from rank, to rank, times in a bin, first bin, place in the bin) of each part of each pattern."""
    taken: dict[int, int] = {}
    out, first = [], 0
    for pattern, times in patterns:
        at = 0
        for length, n in pattern:
            a = taken.get(length, 0)
            taken[length] = a + n * times
            out.append((length, a, a + n * times, n, first, at))
            at += length * n
        first += times
    return out


def pieces(docs: DataFrame, vocab: str, end_id: int, capacity: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Documents as pieces of at most `capacity` ids: id, piece, start, length, ids_crc32."""
    schema = "id bigint, piece int, start bigint, length int, ids_crc32 bigint"

    def cut(batches):
        for batch in batches:
            ids_col, texts = batch.column(0), batch.column(1)
            for first, ids, at in encoded(vocab, texts, end_id):
                rows: tuple[list, ...] = ([], [], [], [], [])
                wide = ids.astype("<u4")
                for k in range(len(at) - 1):
                    own = wide[at[k] : at[k + 1]]
                    n = len(own)
                    head = (n - 1) % capacity + 1
                    start = 0
                    for p in range(-(-n // capacity)):
                        stop = head + p * capacity
                        for to, value in zip(rows, (first + k, p, start, stop - start, zlib.crc32(own[start:stop].tobytes())), strict=True):
                            to.append(value)
                        start = stop
                yield pa.RecordBatch.from_arrays(
                    [ids_col.take(pa.array(rows[0])).cast(pa.int64()), pa.array(rows[1], pa.int32()), pa.array(rows[2], pa.int64()), pa.array(rows[3], pa.int32()), pa.array(rows[4], pa.int64())],
                    names=["id", "piece", "start", "length", "ids_crc32"],
                )

    own_, id_, text = plain(docs, id_col, text_col)
    return own_.select(id_.cast("bigint").alias("id"), text.cast("string").alias("t")).mapInArrow(cut, schema)


def ranked(rows: DataFrame, counts: dict[int, int]) -> DataFrame:
    """`rank` of each row among those of its length, from 0; `tag` tells rows apart that agree in all else."""
    chunks = rows.sparkSession.createDataFrame([(int(k), isqrt(int(n)) + 1) for k, n in counts.items()], "length int, chunks int")
    rows = rows.join(F.broadcast(chunks), "length")  # at most `capacity` rows
    rows = rows.withColumn("chunk", F.pmod(F.xxhash64("tag"), F.col("chunks")).cast("int")).drop("chunks")
    sums = rows.groupBy("chunk", "length").agg(F.count(F.lit(1)).alias("n"))
    before = W.partitionBy("length").orderBy("chunk").rowsBetween(W.unboundedPreceding, -1)
    sums = sums.select("chunk", "length", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    inside = W.partitionBy("chunk", "length").orderBy("tag")
    return rows.withColumn("inner", F.row_number().over(inside) - 1).join(sums, ["chunk", "length"]).withColumn("rank", F.col("base") + F.col("inner")).drop("base", "inner", "chunk")


def pack(docs: DataFrame, vocab: str, end_id: int = 2, capacity: int = 1024, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row for each piece: id, piece, start, length, ids_crc32, sequence_id, offset."""
    spark = docs.sparkSession
    # the tag is fixed once the table is written
    rows = materialize(pieces(docs, vocab, end_id, capacity, id_col, text_col).withColumn("tag", F.monotonically_increasing_id()), "pieces")
    counts = {r["length"]: r["n"] for r in rows.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}  # at most `capacity` rows
    made = places(plan(counts, capacity))
    # The plan has at most `capacity` patterns of fewer than sqrt(2 * capacity) lengths each: a fixed bound, also for the cells.
    parts: dict[int, int] = {}
    for p in made:
        parts[p[0]] = parts.get(p[0], 0) + 1
    wide = {k: -(-int(counts[k]) // n) for k, n in parts.items()}
    cells = [(int(p[0]), c, *map(int, p[1:])) for p in made for c in range(int(p[1]) // wide[p[0]], (int(p[2]) - 1) // wide[p[0]] + 1)]
    spots = F.broadcast(spark.createDataFrame(cells, "length int, cell bigint, a bigint, b bigint, each bigint, first_bin bigint, at bigint"))
    wides = F.broadcast(spark.createDataFrame(list(wide.items()), "length int, wide bigint"))
    r = ranked(rows, counts).join(wides, "length").withColumn("cell", F.expr("rank div wide"))
    j = r.join(spots, ["length", "cell"]).where("rank >= a AND rank < b")
    inside = F.col("rank") - F.col("a")
    return j.select(
        "id",
        "piece",
        "start",
        F.col("length").cast("bigint").alias("length"),
        "ids_crc32",
        (F.col("first_bin") + F.floor(inside / F.col("each"))).alias("sequence_id"),
        (F.col("at") + (inside % F.col("each")) * F.col("length")).alias("offset"),
    )
