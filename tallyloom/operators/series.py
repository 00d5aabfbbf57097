"""Running totals with explicit rules for what is missing, over dense grids of periods and categories.

Null policies: `pending` gives no point and does not move the total; `carry` keeps the total and an empty step; `zero` counts a
missing value as a step of 0. Windows are partitioned by series and hold its periods only.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..sources.scratch import materialize


def _window(by: Sequence[str], order: str):
    return W.partitionBy(*[F.col(b) for b in by]).orderBy(order).rowsBetween(W.unboundedPreceding, 0)


def running(value: str, by: Sequence[str], order: str, policy: str) -> Column:
    so_far = F.sum(F.coalesce(F.col(value), F.lit(0))).over(_window(by, order))
    if policy == "pending":
        return F.when(F.col(value).isNotNull(), so_far)
    if policy in ("carry", "zero"):
        return so_far
    raise ValueError(f"no null policy {policy!r}")


def series(rows: DataFrame, value: str, by: Sequence[str], order: str, policy: str, lineage: str | None = None) -> DataFrame:
    """Adds step, running_total and pending; with `lineage` (a column of cells) step_cell and n_cells, how many cells stand up to each point (`lineage.prefix_cells` lists them)."""
    step = F.coalesce(F.col(value), F.lit(0)) if policy == "zero" else F.col(value)
    out = rows.withColumn("running_total", running(value, by, order, policy)).withColumn("step", step)
    out = out.withColumn("pending", F.col(value).isNull() if policy == "pending" else F.lit(False))
    if lineage:
        out = out.withColumn("n_cells", F.count(lineage).over(_window(by, order))).withColumn("step_cell", F.col(lineage))
    return out


def long_series(rows: DataFrame, value: str, by: Sequence[str], order: str, policy: str, partitions: int | None = None, lineage: str | None = None) -> DataFrame:
    """As `series`, for series of any length: one series runs in many tasks.

    Rows are dealt out by ranges of (by, order). A series' total before each of its ranges comes from the ranges' own totals, at most one row for
    each range; inside a range it runs as usual. A missing value does not move the total, so the null policies need no more than that. Rows of one
    series with equal order stand in one range. A null key is a series of its own.
    """
    n = partitions or int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = materialize(rows.repartitionByRange(n, *by, order).withColumn("__range", F.spark_partition_id()), "series")
    own = F.coalesce(F.col(value), F.lit(0))
    key = [*by, "__range"]
    totals = placed.groupBy(*key).agg(F.sum(own).alias("__own"), F.count(lineage or F.lit(None)).alias("__cells"))
    earlier = W.partitionBy(*by).orderBy("__range").rowsBetween(W.unboundedPreceding, -1)
    before = totals.select(*[F.col(k).alias(f"__k{i}") for i, k in enumerate(key)], F.coalesce(F.sum("__own").over(earlier), F.lit(0)).alias("__before"), F.coalesce(F.sum("__cells").over(earlier), F.lit(0)).alias("__held"))
    same = [F.col(k).eqNullSafe(F.col(f"__k{i}")) for i, k in enumerate(key)]
    both = placed.join(before, same)
    total = F.col("__before") + F.sum(own).over(_window(key, order))
    if policy not in ("pending", "carry", "zero"):
        raise ValueError(f"no null policy {policy!r}")
    pending = F.col(value).isNull() if policy == "pending" else F.lit(False)
    out = both.withColumn("running_total", F.when(~pending, total)).withColumn("step", own if policy == "zero" else F.col(value)).withColumn("pending", pending)
    if lineage:
        out = out.withColumn("n_cells", F.col("__held") + F.count(lineage).over(_window(key, order))).withColumn("step_cell", F.col(lineage))
    return out.drop("__range", "__before", "__held", *[f"__k{i}" for i in range(len(key))])


def dense(sums: DataFrame, periods: DataFrame, categories: DataFrame, on: Sequence[str]) -> DataFrame:
    """Every category gets every period, as the chart it feeds shows it.

    The time axis is one short list that is sent to each category's row; categories may be many.
    """
    axis = periods.agg(F.collect_list(F.struct(*periods.columns)).alias("__axis"))
    grid = categories.crossJoin(F.broadcast(axis)).withColumn("__period", F.explode("__axis"))
    grid = grid.select(*[F.col("__period")[c].alias(c) for c in periods.columns], *categories.columns)
    return grid.join(sums, list(on), "left")


def pending_periods(rows: DataFrame, period: str, actual: str) -> DataFrame:
    """Periods for which no channel has an actual."""
    return rows.groupBy(period).agg(F.bool_and(F.col(actual).isNull()).alias("pending")).where("pending").select(period)


def dormant(goal: str, actual: str) -> Column:
    return (F.coalesce(F.col(goal), F.lit(0)) == 0) & (F.coalesce(F.col(actual), F.lit(0)) == 0)
