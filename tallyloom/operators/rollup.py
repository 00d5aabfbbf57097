"""Rollups: additive metrics are summed, ratios are rebuilt from the sums and never averaged.

One grouped pass does all levels (GROUPING SETS); sums are partial before the shuffle. Lineage, the cells behind a
figure, is optional; it is kept as runs of cells (`lineage`), which grow with a group's gaps and not with its rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.semantics import exact_sum, ratio
from .catalog import Catalog
from .lineage import gathered, runs


def sums(metrics: Catalog, total=None) -> list[Column]:
    """total: another sum than the exact one of the metric's kind."""
    return [(total(F.col(m.key)) if total else exact_sum(m.key, m.kind)).alias(m.key) for m in metrics.additive]


def with_ratios(summed: DataFrame, metrics: Catalog) -> DataFrame:
    """Add each ratio from its summed components; null where they are unknown."""
    made = {m.key: ratio(m.numerator, m.denominator) if m.numerator else F.lit(None).cast("double") for m in metrics.ratios}
    return summed.withColumns(made) if made else summed


def rollup(rows: DataFrame, by: Sequence[str], metrics: Catalog, extra: Sequence[Column] = (), total=None) -> DataFrame:
    """One level: a row for each group, or one row in all."""
    grouped = rows.groupBy(*by).agg(*sums(metrics, total), F.count(F.lit(1)).alias("row_count"), *extra)
    return with_ratios(grouped, metrics)


def rollup_sets(rows: DataFrame, sets: Sequence[Sequence[str]], metrics: Catalog, level: str = "level", extra: Sequence[Column] = ()) -> DataFrame:
    """Several levels at once, told apart by `level` (the grouping id, as a null group is not a total)."""
    keys = list(dict.fromkeys(k for s in sets for k in s))
    columns = [[F.col(k) for k in s] for s in sets]
    grouped = rows.groupingSets(columns, *[F.col(k) for k in keys]).agg(F.grouping_id().cast("int").alias(level), *sums(metrics), F.count(F.lit(1)).alias("row_count"), *extra)
    return with_ratios(grouped, metrics)


def monthly(rows: DataFrame, metrics: Catalog, key: str = "month_key", label: str = "month", order: str = "row") -> DataFrame:
    """By month in order of first appearance, without the rows that name no month."""
    first = [F.min(order).alias("first_row"), F.min_by(label, order).alias("label")]
    return rollup(rows.where(F.col(key).isNotNull() & (F.col(key) != "")), [key], metrics, first)


def year_to_date(rows: DataFrame, metrics: Catalog) -> DataFrame:
    """Sums start at 0 here, so that nothing reported is 0."""
    made = [F.coalesce(exact_sum(m.key, m.kind), F.lit(0.0)).alias(m.key) for m in metrics.additive]
    return with_ratios(rows.agg(*made, F.count(F.lit(1)).alias("row_count")), metrics)


def long_rollup(values: DataFrame, by: Sequence[str], with_lineage: bool = False) -> DataFrame:
    """Over long metrics (metric_key, value, cell): the canonical form for an open set of metrics. with_lineage: adds `runs`."""
    keys = [*by, "metric_key"]
    summed = values.groupBy(*keys).agg(F.sum("value").alias("value"), F.count(F.lit(1)).alias("row_count"))
    if not with_lineage:
        return summed
    own = gathered(runs(values, keys), keys)
    own = own.select(*[F.col(k).alias(f"__k{i}") for i, k in enumerate(keys)], "runs")
    same = [F.col(k).eqNullSafe(F.col(f"__k{i}")) for i, k in enumerate(keys)]
    return summed.join(own, same, "left").select(*keys, "value", "row_count", F.coalesce("runs", F.array().cast(own.schema["runs"].dataType)).alias("runs"))


def rebuilt_ratios(summed: DataFrame, by: Sequence[str], catalog: DataFrame) -> DataFrame:
    """Long form: a ratio's row from the rows of its components.

    catalog (metric_key, numerator, denominator) has a row for each column of a report; it is broadcast.
    """
    lineage = "runs" in summed.columns
    maps = [F.map_from_entries(F.collect_list(F.struct("metric_key", "value"))).alias("v")]
    if lineage:
        maps.append(F.map_from_entries(F.collect_list(F.struct("metric_key", "runs"))).alias("c"))
    groups = summed.groupBy(*by).agg(*maps) if by else summed.agg(*maps)
    wanted = F.broadcast(catalog.where("numerator IS NOT NULL").select("metric_key", "numerator", "denominator"))
    pairs = groups.crossJoin(wanted)
    at = lambda m, k: F.try_element_at(F.col(m), F.col(k))
    out = [F.col(b) for b in by] + [F.col("metric_key"), ratio(at("v", "numerator"), at("v", "denominator")).alias("value")]
    if lineage:
        empty = F.array().cast(summed.schema["runs"].dataType)
        out.append(F.concat(F.coalesce(at("c", "numerator"), empty), F.coalesce(at("c", "denominator"), empty)).alias("runs"))
    return pairs.select(*out)


def naive_average(rows: DataFrame, by: Sequence[str], key: str) -> DataFrame:
    """The mean of stored ratios: what a rollup must not give."""
    return rows.groupBy(*by).agg(F.avg(key).alias("naive"))
