"""Lineage as runs of cells: which cells stand behind a figure, without a list of them.

Cells of one column that follow each other are one run (col, first, last). A set of cells is as many runs as it has gaps, and is spelled out only on
request (`cells_of`). The lineage of a running total is a prefix of its series: each point knows how many cells stand up to it (`n_cells`), so a series
of n points takes n rows and not n * n / 2 cells; `prefix_cells` spells out.

Runs are found in chunks of a fixed number of sheet rows, so that no group has to meet in one task; then only runs that touch the edge of
their chunk, two for each chunk at most, are joined to their neighbours.

Defined results: a cell that is named twice in a group counts once; a null cell, or one that is no reference, stands in no run; null keys are a group.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Rows of a sheet in which runs are looked for at once.
CHUNK = 1 << 16
RUN = ("col", "first", "last")


def runs(rows: DataFrame, by: Sequence[str], cell: str = "cell", chunk: int = CHUNK) -> DataFrame:
    """(by, col, first, last): the cells of each group as runs that neither touch nor overlap."""
    keys = [*by, "col"]
    ref = lambda i: F.regexp_extract(cell, r"^([A-Z]+)([0-9]+)$", i)
    named = rows.where(F.col(cell).isNotNull() & F.col(cell).rlike(r"^[A-Z]+[0-9]+$"))
    one = named.select(*by, ref(1).alias("col"), ref(2).cast("bigint").alias("r")).withColumn("__c", F.expr(f"r div {chunk}"))
    # in a run, the row and its rank rise together
    rank = F.dense_rank().over(W.partitionBy(*keys, "__c").orderBy("r"))
    found = one.withColumn("__i", F.col("r") - rank).groupBy(*keys, "__c", "__i").agg(F.min("r").alias("first"), F.max("r").alias("last"))
    edge = (F.col("first") % chunk == 0) | (F.col("last") % chunk == chunk - 1)
    inner = found.where(~edge).select(*keys, "first", "last")
    w = W.partitionBy(*keys).orderBy("first")  # two rows for each chunk, at most
    starts = F.coalesce(F.col("first") != F.lag("last").over(w) + 1, F.lit(True))
    outer = found.where(edge).withColumn("__s", starts.cast("int")).withColumn("__i", F.sum("__s").over(w))
    outer = outer.groupBy(*keys, "__i").agg(F.min("first").alias("first"), F.max("last").alias("last")).select(*keys, "first", "last")
    return inner.unionByName(outer)


def gathered(found: DataFrame, by: Sequence[str], name: str = "runs") -> DataFrame:
    """(by, runs): the runs of each group as one ordered list; a list is as long as its group has gaps."""
    return found.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct(*RUN))).alias(name))


def n_cells(runs_: Column | str) -> Column:
    """How many cells a list of runs stands for."""
    return F.aggregate(runs_, F.lit(0).cast("bigint"), lambda n, x: n + x["last"] - x["first"] + 1)


def cells_of(runs_: Column | str) -> Column:
    """A list of runs spelled out."""
    return F.flatten(F.transform(runs_, lambda x: F.transform(F.sequence(x["first"], x["last"]), lambda r: F.concat(x["col"], r.cast("string")))))


def prefix_cells(points: DataFrame, by: Sequence[str], cell: str = "step_cell", count: str = "n_cells", name: str = "step_cells") -> DataFrame:
    """Points of series with the cells up to each spelled out: the series' cells are gathered once, and each point takes its first ones."""
    own = points.where(F.col(cell).isNotNull()).groupBy(*by).agg(F.array_sort(F.collect_list(F.struct(count, cell))).alias("__all"))
    own = own.select(*[F.col(b).alias(f"__k{i}") for i, b in enumerate(by)], F.transform("__all", lambda x: x[cell]).alias("__all"))
    same = [F.col(b).eqNullSafe(F.col(f"__k{i}")) for i, b in enumerate(by)] or F.lit(True)
    upto = F.when(F.col(count) > 0, F.slice("__all", F.lit(1), F.col(count).cast("int")))
    out = points.join(own, same, "left").withColumn(name, F.coalesce(upto, F.array().cast("array<string>")))
    return out.drop("__all", *[f"__k{i}" for i in range(len(by))])
