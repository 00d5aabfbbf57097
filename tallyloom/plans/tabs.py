"""One workbook's tabs as values: its layout and figures on the driver, its tables as DataFrames over the records of `many.Reports`."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F

from ..functions import semantics as S
from ..operators import rollup, series
from ..operators.catalog import Catalog, Metric
from ..operators.lineage import prefix_cells
from ..sources.workbook import column_letters
from .layout import FLAT, FlatSpec
from .many import Reports, flat_detail


@dataclass
class Tab:
    """What one tab gives: tables, small facts and what was noticed."""

    name: str
    #: the sheet that it was read from
    sheet: str = ""
    meta: dict = field(default_factory=dict)
    catalog: Catalog = field(default_factory=Catalog)
    tables: dict[str, DataFrame] = field(default_factory=dict)
    lists: dict[str, list] = field(default_factory=dict)
    findings: list[str] = field(default_factory=list)
    problems: list[dict] = field(default_factory=list)

    @property
    def failed(self) -> bool:
        return any(p["level"] == "error" for p in self.problems)


def metric_table(spark, cat: Catalog) -> DataFrame:
    rows = [(i, m.key, m.label, m.kind, m.column, m.additive, m.numerator, m.denominator, m.unresolvable) for i, m in enumerate(cat.metrics)]
    return spark.createDataFrame(rows, "metric_ord int, metric_key string, label string, kind string, col string, additive boolean, numerator string, denominator string, unresolvable boolean")


def _number(key: str):
    return F.try_element_at(F.col("n"), F.lit(key))


def long_metrics(rows: DataFrame, columns: dict[str, int], prefix: str = "m", name: str = "metric_key") -> DataFrame:
    """(row, metric_key, value, cell, formula) of each record and field, also where the cell is blank."""
    one = [
        F.struct(F.lit(k).alias(name), _number(f"{prefix}:{k}").alias("value"), F.concat(F.lit(column_letters(c)), F.col("row").cast("string")).alias("cell"), F.try_element_at(F.col("f"), F.lit(f"{prefix}:{k}")).alias("formula"))
        for k, c in columns.items()
    ]  # as many as the header has columns
    return rows.select("row", F.explode(F.array(*one)).alias("x")).select("row", "x.*")


def lineage(tab: Tab) -> DataFrame:
    """(month_key, metric_key, value, runs) of a flat tab: each monthly figure with the runs of cells behind it, a ratio's numerator first."""
    long = tab.tables["metrics_long"].join(tab.tables["detail"].select("row", "month_key"), "row")
    summed = rollup.long_rollup(long.where(F.col("metric_key").isin(*[m.key for m in tab.catalog.additive])), ["month_key"], with_lineage=True)
    return summed.drop("row_count").unionByName(rollup.rebuilt_ratios(summed, ["month_key"], tab.tables["metric_catalog"]))


def flat_tables(tab: Tab, spec: FlatSpec, rows: DataFrame, fields: dict[str, dict[str, int]], keys: Sequence[str]) -> None:
    own = rows.where("block = 'detail'")
    dims = [k[2:] for k in fields["detail"] if k.startswith("d:")]
    columns = {k[2:]: c for k, c in fields["detail"].items() if k.startswith("m:")}
    detail = flat_detail(rows, spec, dims).withColumns({f"m_{k}" if k in dims else k: _number(f"m:{k}") for k in columns})
    detail = tab.tables["detail"] = detail.drop("workbook", "tab", "block", "t", "n", "b", "f")
    tab.tables["metrics_long"] = long_metrics(own, columns)
    tab.tables["metric_catalog"] = metric_table(rows.sparkSession, tab.catalog)
    plain = lambda c: F.sum(c)  # noqa: E731  a sheet's numbers are not cents only
    cat = tab.catalog if spec.has_ratios else Catalog(tab.catalog.additive)
    by_month = detail.where("month_key <> ''")
    first = [F.min("row").alias("first_row"), F.min_by("month", "row").alias("label"), F.sort_array(F.collect_list("row")).alias("rows")]
    tab.tables["monthly"] = rollup.rollup(by_month, ["month_key"], cat, first, plain)
    tab.tables["quarter_to_date"] = rollup.rollup(detail, [], cat, [F.sort_array(F.collect_list("row")).alias("rows")], plain)
    if not keys:
        return
    months = by_month.groupBy("month_key").agg(F.min("row").alias("period_ord"), F.min_by("month", "row").alias("label"))
    values = by_month.select("month_key", *spec.slices, *keys).unpivot(["month_key", *spec.slices], list(keys), "metric_key", "value")
    whole = values.select("month_key", "metric_key", "value", F.lit("all").alias("slice_type"), F.lit("all").alias("slice_value"))
    for s in spec.slices:
        whole = whole.unionByName(values.where(F.col(s).isNotNull()).select("month_key", "metric_key", "value", F.lit(s).alias("slice_type"), F.col(s).alias("slice_value")))
    named = ["slice_type", "slice_value", "metric_key"]
    sums = whole.groupBy("month_key", *named).agg(F.sum("value").alias("value"))
    grid = series.dense(sums, months, whole.select(*named).distinct(), ["month_key", *named])
    tab.tables["series"] = series.series(grid, "value", named, "period_ord", "zero")


def digital_tables(tab: Tab, table: DataFrame, rows: DataFrame, fields: dict[str, dict[str, int]]) -> None:
    table = tab.tables["channel_period"] = table.drop("workbook", "tab_sound")
    monthly = table.where("block = 'channel' AND period_key <> 'quarter'")
    # keyed by row, so that channels of one name keep a series each
    by = ["row", "channel"]
    with_cells = lambda value, policy: prefix_cells(series.series(monthly, value, by, "period_ord", policy, f"{value}_cell"), by)  # noqa: E731  a channel has as many periods as the sheet has columns
    goal = with_cells("goal", "carry").select(*by, "period_key", "period_ord", F.col("running_total").alias("cum_goal"), F.col("step_cells").alias("goal_cells"))
    actual = with_cells("actual", "pending").select(*by, "period_key", F.col("running_total").alias("cum_actual"), "pending", F.col("step_cells").alias("actual_cells"))
    tab.tables["series"] = goal.join(actual, [*by, "period_key"])
    helpers = {k[2:]: c for k, c in fields["channel"].items() if k.startswith("h:")}
    if helpers:
        tab.tables["helpers"] = long_metrics(rows.where("block = 'channel'"), helpers, "h", "period_key")


def paid_tables(tab: Tab, rows: DataFrame, fields: dict[str, dict[str, int]], keys: Sequence[str]) -> None:
    for block, cols in fields.items():
        own = rows.where(F.col("block") == block)
        dims = {k[2:]: (_number(k) if k == "d:quarter" else F.try_element_at(F.col("t"), F.lit(k))) for k in cols if k.startswith("d:")}
        metrics = {k[2:]: c for k, c in cols.items() if k.startswith("m:")}
        tab.tables[block] = own.select("row", *[v.alias(k) for k, v in dims.items()], *[_number(f"m:{k}").alias(k) for k in metrics])
        tab.tables[f"{block}_metrics"] = long_metrics(own, metrics)
    tab.tables["quarterly"] = tab.tables["quarterly"].withColumn("label", S.quarter_label("quarter")).withColumn("quarter", F.floor(F.col("quarter") + 0.5).cast("int"))
    tab.tables["metric_catalog"] = metric_table(rows.sparkSession, tab.catalog)
    plain = lambda c: F.coalesce(F.sum(c), F.lit(0.0))
    tab.tables["year_to_date"] = rollup.rollup(tab.tables["quarterly"], [], tab.catalog, total=plain)
    for k in ("quarterly", "monthly"):
        long = tab.tables[f"{k}_metrics"].where(F.col("metric_key").isin(*keys))
        # a document lists the cells; the rows of these blocks are few
        tab.tables[f"{k}_series"] = prefix_cells(series.series(long, "value", ["metric_key"], "row", "carry", "cell"), ["metric_key"]).drop("n_cells", "step_cell")


def tab_of(reports: Reports, name: str, layout: Sequence[Row], problems: Sequence[Row], findings: Sequence[Row], lists: Sequence[Row], period: Row | None, rows: DataFrame, channel_period: DataFrame) -> Tab:
    """The tab of one workbook. layout and so on: collected rows of this tab; rows: the workbook's records."""
    of = lambda kind: [r for r in layout if r["kind"] == kind]
    tab = Tab(name, sheet=next((r["sheet"] for r in of("tab")), None) or "")
    tab.catalog = Catalog([Metric(r["key"], r["label"], r["field"], column_letters(r["col"]), r["numerator"], r["denominator"]) for r in of("metric")])
    tab.meta = {r["key"]: r["num"] if r["field"] == "num" else r["txt"] for r in of("meta")}
    tab.problems = [{k: p[k] for k in ("tab", "level", "rule_id", "text", "sections", "cells", "more_cells")} for p in problems]
    tab.findings = [f["text"] for f in sorted(findings, key=lambda f: f["at"])]
    fields: dict[str, dict[str, int]] = {}
    for r in of("field"):
        fields.setdefault(r["block"], {})[r["key"]] = r["col"]
    if not fields:
        return tab
    own = rows.where(F.col("tab") == name)
    keys = [r["key"] for r in of("series")]
    names = (*FLAT[name].slices,) if name in FLAT else ("channels", "dormant", "pending") if name == "digital" else ()
    tab.lists = {k: [r["value"] for r in sorted(lists, key=lambda r: r["ord"]) if r["list"] == k] for k in names}
    if name == "digital":
        tab.lists["toggles"] = [{"month": r["key"], "cell": r["label"], "value": bool(r["num"])} for r in of("toggle")]
        tab.meta["sources"] = {r["key"]: r["txt"] for r in of("source")}
        digital_tables(tab, channel_period, own, fields)
    elif name == "paid":
        tab.lists["definitions"] = [{"term": r["key"], "text": r["txt"], "term_cell": r["label"], "text_cell": r["field"]} for r in of("definition")]
        paid_tables(tab, own, fields, keys)
    else:
        if not FLAT[name].labelled_period:
            year, quarter = period["text"].split(" ") if period else (None, None)
            tab.meta = {"year": year and float(year), "quarter": quarter and float(quarter)}
        flat_tables(tab, FLAT[name], own, fields, keys)
    return tab
