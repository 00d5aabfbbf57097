"""What a report page asks of the detail: filters, the leaderboard, stacked totals, the scatter, order of channels."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .catalog import Catalog
from .rollup import rollup, rollup_sets


def filtered(rows: DataFrame, **chips: str | None) -> DataFrame:
    """Equality filters that all must hold; None or "all" filters nothing."""
    for column, value in chips.items():
        if value not in (None, "all"):
            rows = rows.where(F.col(column) == value)
    return rows


def leaderboard(rows: DataFrame, by: Sequence[str], metrics: Catalog, order: str, descending: bool = True, totals: bool = False) -> DataFrame:
    """A row for each group, sorted; with totals, one more (level > 0) over the same filtered rows."""
    out = rollup_sets(rows, [list(by), []], metrics) if totals else rollup(rows, by, metrics)
    key = F.desc_nulls_last(order) if descending else F.asc_nulls_last(order)
    return out.orderBy(*(["level"] if totals else []), key, *by)


def channel_order(channels: DataFrame, pct: str, dormant: str, name: str) -> DataFrame:
    """Adds place: by percent to goal, dormant channels last. As many rows as there are channels."""
    rank = F.when(F.col(dormant), -1.0).otherwise(F.coalesce(F.col(pct), F.lit(0.0)))
    return channels.withColumn("place", F.row_number().over(W.orderBy(rank.desc(), name)))


def stack(rows: DataFrame, period: str, dim: str, values: Sequence[str], metric: str) -> DataFrame:
    """A metric by period with a column for each of the given values of a dimension."""
    return rows.groupBy(period).pivot(dim, list(values)).agg(F.sum(F.col(metric).cast("decimal(18,2)")).cast("double"))


def scatter(rows: DataFrame, cost: str, back: str) -> DataFrame:
    return rows.where(F.col(cost).isNotNull() & (F.col(cost) > 0) & F.col(back).isNotNull())


def single_period(rows: DataFrame, by: Sequence[str], day: str) -> DataFrame:
    """Year and quarter of each group if all its dated rows lie in one quarter, else null."""
    dated = rows.where(F.col(day).isNotNull()).select(*by, F.year(day).alias("y"), F.quarter(day).alias("q"))
    quarters = dated.groupBy(*by, "y", "q").agg(F.count(F.lit(1)).alias("n"))
    one = F.count(F.lit(1)) == 1
    return quarters.groupBy(*by).agg(F.when(one, F.min("y")).alias("year"), F.when(one, F.min("q")).alias("quarter"), F.count(F.lit(1)).alias("n_quarters"))
