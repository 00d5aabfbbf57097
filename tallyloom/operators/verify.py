"""Checks of a report as tables: a failing row is a finding. Each figure is computed a second way, from the cells up."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import semantics as S
from ..plans.tabs import Tab
from .lineage import cells_of

CHECK = "check string, subject string, stored double, expected double"
MONEY, RATIO, PROVENANCE = 0.02, 1e-6, 0.005


#: Tasks of a tab's checks. A tab is a sheet, which the file format bounds, and each task sends the metrics of the whole plan to the driver.
TASKS = 8


def _hit(when: Column, name: str, subject: Column | str, stored: Column | str | None = None, expected: Column | str | None = None) -> Column:
    """The finding of a row, or null."""
    c = lambda x: F.col(x) if isinstance(x, str) else F.lit(x)
    found = F.struct(F.lit(name).alias("check"), c(subject).cast("string").alias("subject"), c(stored).cast("double").alias("stored"), c(expected).cast("double").alias("expected"))
    return F.when(when, found)


def _off(name: str, subject: Column | str, stored: Column | str, expected: Column | str, tolerance: float | Column, when: Column | None = None) -> Column:
    """The finding of a row whose figures differ, of the rows that the check is for."""
    c = lambda x: F.col(x) if isinstance(x, str) else x
    bad = ~S.close(c(stored), c(expected), tolerance)
    return _hit(bad if when is None else when & bad, name, subject, stored, expected)


def _found(rows: DataFrame, *checks: Column) -> DataFrame:
    """The findings of any number of checks of the same rows, in one pass."""
    if not checks:
        return rows.sparkSession.createDataFrame([], CHECK)
    return rows.select(F.explode(F.array_compact(F.array(*checks))).alias("x")).select("x.*")


def _fail(rows: DataFrame, name: str, subject: Column | str, stored: Column | str, expected: Column | str, tolerance: float | Column) -> DataFrame:
    return _found(rows, _off(name, subject, stored, expected, tolerance))


def _named(rows: DataFrame, check: str, subject: Column | str, stored: Column | None = None, expected: Column | None = None) -> DataFrame:
    """Every row is a finding."""
    return _found(rows, _hit(F.lit(True), check, subject, stored, expected))


def _all(parts: Sequence[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def _findings(parts: Sequence[DataFrame]) -> DataFrame:
    """All findings of a tab, in a fixed number of tasks."""
    return _all(parts).coalesce(TASKS)


def digital(tab: Tab) -> DataFrame:
    t = tab.tables["channel_period"]
    own = t.where("block = 'channel'")
    subject = F.concat_ws(" ", "channel", "period_key")
    rated = S.truthy("goal") & F.col("actual").isNotNull() & F.col("pct").isNotNull()
    out = [_found(own, _off("percent is actual over goal", subject, "pct", F.try_divide("actual", "goal"), RATIO, rated))]
    months = own.where("period_key <> 'quarter'").groupBy("row", "channel").agg(F.sum("actual").alias("total"))
    quarter = own.where("period_key = 'quarter'").select("row", "actual")
    out.append(_fail(quarter.join(months, "row").where("total IS NOT NULL"), "months sum to the quarter", "channel", "actual", "total", MONEY))
    whole = t.where((F.col("block") == "overall") & (S.slug("channel") == "total_raised")).select("period_key", F.col("goal").alias("g"), F.col("actual").alias("a"))
    sums = own.groupBy("period_key").agg(F.sum("goal").alias("goal"), F.sum("actual").alias("actual")).join(whole, "period_key")
    actuals = _off("channels sum to overall actual", "period_key", "a", "actual", MONEY, F.col("a").isNotNull() & F.col("actual").isNotNull())
    out.append(_found(sums, actuals, _off("channels sum to overall goal", "period_key", "g", "goal", MONEY, F.col("g").isNotNull())))
    rows = {k: t.where((F.col("block") == "overall") & (S.slug("channel") == k)).select("period_key", F.col("actual").alias(k)) for k in ("total_raised", "total_donations", "average_donation")}
    mean = rows["total_raised"].join(rows["total_donations"], "period_key").join(rows["average_donation"], "period_key")
    mean = mean.where(S.truthy("total_raised") & S.truthy("total_donations") & F.col("average_donation").isNotNull())
    out.append(_fail(mean, "average donation is raised over donations", "period_key", "average_donation", F.col("total_raised") / F.col("total_donations"), RATIO))
    if "helpers" in tab.tables:
        fixed = [x["month"] for x in tab.lists.get("toggles", []) if not x["value"]]  # a dynamic goal counts actuals
        mirror = tab.tables["helpers"].where(F.col("period_key").isin(fixed)).select("row", "period_key", "value").join(own, ["row", "period_key"]).where("value IS NOT NULL")
        out.append(_fail(mirror, "a helper holds its month's goal", subject, "value", F.coalesce("goal", F.lit(0.0)), MONEY))
        helpers = tab.tables["helpers"].groupBy("row").agg(F.sum("value").alias("total"))
        goals = own.where("period_key = 'quarter'").select("row", "channel", "goal")
        out.append(_fail(goals.join(helpers, "row"), "helpers sum to the quarter's goal", "channel", "goal", "total", MONEY))
    return _findings(out)


def _rebuilt(tab: Tab, table: str, tolerance: float = RATIO) -> list[Column]:
    """Checks of a rollup's rows: ratios are rebuilt from their sums, and those of unknown components are blank."""
    have, out = tab.tables[table].columns, []
    for m in tab.catalog.ratios:
        if m.numerator and m.key in have:
            out.append(_off(f"{table}: {m.key} is rebuilt", F.lit(m.key), m.key, S.ratio(m.numerator, m.denominator), tolerance))
    return out


def _blank(tab: Tab, table: str) -> list[Column]:
    own = [m.key for m in tab.catalog.ratios if m.unresolvable and m.key in tab.tables[table].columns]
    return [_hit(F.col(k).isNotNull(), f"{table}: {k} is blank, as its components are unknown", F.lit(k), k) for k in own]


def ratios(tab: Tab, table: str, tolerance: float = RATIO) -> DataFrame:
    """Rebuilt ratios of a rollup, and blanks under a zero denominator."""
    return _found(tab.tables[table], *_rebuilt(tab, table, tolerance))


def _over_zero(tab: Tab) -> list[Column]:
    return [_hit(~S.truthy(m.denominator) & F.col(m.key).isNotNull(), f"{m.key} is blank over zero", "row", m.key) for m in tab.catalog.ratios if m.numerator]


def blank_under_zero(tab: Tab, table: str = "detail") -> DataFrame:
    """A stored ratio over nothing must be blank."""
    return _found(tab.tables[table], *_over_zero(tab))


def _sums(children: DataFrame, parents: DataFrame, by: str, keys: Sequence[str], check: str, loose: dict[str, float] | None = None) -> DataFrame:
    """Each key of each parent is the sum of its children, where a parent has it."""
    sums = children.groupBy(by).agg(*[F.sum(F.coalesce(k, F.lit(0.0))).alias(f"s_{k}") for k in keys])
    return _found(parents.join(sums, by), *[_off(check, F.concat_ws(" ", F.col(by), F.lit(k)), k, f"s_{k}", (loose or {}).get(k, MONEY), F.col(k).isNotNull()) for k in keys])


def paid(tab: Tab) -> DataFrame:
    """Ratios of the year, sums of months and of the chosen quarter, no total above its parts, a gap where names are counted once, and the structure."""
    keys, loose = [m.key for m in tab.catalog.additive], {"ntl": 0.5}
    monthly = tab.tables["monthly"].withColumn("m", F.trim("label"))
    detail, quarterly = tab.tables["detail"].withColumn("m", F.trim("month")), tab.tables["quarterly"]
    raised = {"total_raised", "immediate_raised", "lifetime_raised"}
    parts = F.col("immediate_raised") + F.col("lifetime_raised")
    above = {b: [_hit(F.col("total_raised") > parts + MONEY, f"{b}: total raised is at most its parts", "row", "total_raised", parts)] if raised <= set(tab.tables[b].columns) else [] for b in ("quarterly", "monthly", "detail")}
    nameless = _hit(F.col("channel").isNull() | F.col("placement").isNull() | F.col("m").isNull(), "a detail row names its month, channel and placement", "row")
    out = [ratios(tab, "year_to_date"), _found(detail, *_over_zero(tab), *above["detail"], nameless)]
    out += [_found(tab.tables[b], *above[b]) for b in ("quarterly", "monthly") if above[b]]
    out.append(_sums(detail, monthly, "m", keys, "detail rows sum to their month", loose))
    out.append(_named(detail.select("m").distinct().join(monthly.select("m"), "m", "left_anti"), "a detail month has a monthly row", "m"))
    out.append(_named(monthly.select("m").join(detail.select("m"), "m", "left_anti"), "a month has detail rows", "m"))
    if tab.meta.get("quarter") is not None:
        number = int(tab.meta["quarter"] + 0.5)
        chosen = quarterly.where(F.col("quarter") == number).orderBy("row").limit(1)
        out.append(_named(chosen.agg(F.count(F.lit(1)).alias("n")).where("n = 0"), "the chosen quarter has a row", F.lit(str(number))))
        out.append(_sums(monthly.withColumn("quarter", F.lit(number)), chosen, "quarter", keys, "months sum to the chosen quarter", loose))
        if {"total_roas", "gross_spend", "total_raised"} <= set(quarterly.columns):
            whole = monthly.agg(F.sum("gross_spend").alias("spend"), F.sum("total_raised").alias("got")).where("spend <> 0")
            out.append(_fail(chosen.select("total_roas").crossJoin(whole).where("total_roas IS NOT NULL"), "the quarter's return holds for its months", F.lit("total_roas"), "total_roas", F.col("got") / F.col("spend"), RATIO))
        if raised <= set(quarterly.columns):
            same = chosen.where(F.abs(F.col("total_raised") - parts) <= MONEY)
            out.append(_named(same, "names are counted once in the chosen quarter, so its total is below its parts", "row", F.col("total_raised"), parts))
    return _findings(out)


def flat(tab: Tab, unique: str | None = None, required: Sequence[str] = (), unresolvable: Sequence[str] | None = None, non_negative: Sequence[str] = (), derived: bool = False) -> DataFrame:
    """Rollups from the rows up, ratios rebuilt or blank, ends of all series, lists, keys and required fields. Checks of the same rows share a pass.

    unresolvable: the only ratios that may lack components. derived: the period must be that of all dated rows.
    """
    detail, month, quarter = tab.tables["detail"], tab.tables["monthly"], tab.tables["quarter_to_date"]
    absent = [_hit(F.col(f).isNull(), f"a detail row has its {f}", "row") for f in required]
    below = [_hit(F.col(f) < 0, f"{f} is not negative", "row", f) for f in non_negative]
    out = [_found(rows, *checks) for rows, checks in ((month, _rebuilt(tab, "monthly") + _blank(tab, "monthly")), (quarter, _rebuilt(tab, "quarter_to_date") + _blank(tab, "quarter_to_date")), (detail, _over_zero(tab) + absent + below)) if checks]
    keys = [m.key for m in tab.catalog.additive]
    loose = {k: 0.5 for k in keys if "recipients" in k}
    named = detail.where("month_key <> ''")
    left = detail.where("month_key = ''").agg(*[F.coalesce(F.sum(k), F.lit(0.0)).alias(f"l_{k}") for k in keys])
    sums = month.agg(*[F.coalesce(F.sum(k), F.lit(0.0)).alias(f"s_{k}") for k in keys]).crossJoin(left).crossJoin(quarter.select(*keys))
    out.append(_found(sums, *[_off("months sum to the quarter", F.lit(k), F.coalesce(k, F.lit(0.0)), F.col(f"s_{k}") + F.col(f"l_{k}"), loose.get(k, MONEY)) for k in keys]))
    out.append(_sums(named, month, "month_key", keys, "detail rows sum to their month", loose))
    own = named.groupBy("month_key").agg(F.sort_array(F.collect_list("row")).alias("own"), F.count(F.lit(1)).alias("n"))
    differs = lambda a, b: ~F.coalesce(F.col(a) == F.col(b), F.lit(False))
    lists = _hit(differs("rows", "own"), "a month lists its own rows", "month_key", F.size("rows"), "n")
    out.append(_found(month.join(own, "month_key", "full_outer"), lists, _hit(differs("row_count", "n"), "a month counts its own rows", "month_key", "row_count", "n")))
    total = quarter.select("row_count").crossJoin(detail.agg(F.count(F.lit(1)).alias("n")))
    out.append(_named(total.where("row_count <> n"), "the quarter counts all rows", F.lit("rows"), F.col("row_count"), F.col("n")))
    spark = detail.sparkSession
    if unresolvable is not None and (odd := {m.key for m in tab.catalog.ratios if m.unresolvable} ^ set(unresolvable)):
        out.append(_named(spark.createDataFrame([(k,) for k in sorted(odd)], "k string"), "the ratios without components are the known ones", "k"))
    if "series" in tab.tables:
        ends = tab.tables["series"].groupBy("slice_type", "slice_value", "metric_key").agg(F.max_by("running_total", "period_ord").alias("end"))
        slices = {"all": F.lit("all")} | {s: F.col(s) for s in tab.lists if s in detail.columns}
        have = [r["metric_key"] for r in ends.select("metric_key").distinct().collect()]  # a few metrics
        by = ["slice_type", "slice_value"]
        cut = F.explode(F.array(*[F.struct(F.lit(s).alias("slice_type"), v.alias("slice_value")) for s, v in slices.items()]))
        rows = named.select(cut.alias("s"), *have).select("s.*", *have).where("slice_value IS NOT NULL")
        want = rows.groupBy(*by).agg(*[F.sum(F.coalesce(k, F.lit(0.0))).alias(k) for k in have]).unpivot(by, have, "metric_key", "total")
        got = ends.where(F.col("slice_type").isin(*slices)).join(want, [*by, "metric_key"], "full_outer")
        out.append(_fail(got, "a series ends at its total", F.concat_ws(" ", *by, "metric_key"), "end", "total", MONEY))
        if both := [k for k in have if k in month.columns]:
            totals = month.agg(*[F.sum(k).alias(k) for k in both]).unpivot([], both, "metric_key", "total")
            whole = ends.where("slice_type = 'all'").join(totals, "metric_key")
            out.append(_fail(whole, "a series ends at its total", "metric_key", "end", F.coalesce("total", F.lit(0.0)), MONEY))
    if listed := [s for s in tab.lists if s in detail.columns]:
        names = F.explode(F.array(*[F.struct(F.lit(s).alias("list"), F.col(s).alias("value")) for s in listed]))
        rows = detail.select(names.alias("s")).select("s.*").where("value <> ''").distinct().withColumn("in_rows", F.lit(True))
        said = spark.createDataFrame([(s, x) for s in listed for x in tab.lists[s]], "list string, value string").distinct().withColumn("in_list", F.lit(True))
        one_side = rows.join(said, ["list", "value"], "full_outer").where("in_rows IS NULL OR in_list IS NULL")
        out.append(_found(one_side, *[_hit(F.col("list") == s, f"the list of {s} is that of the rows", "value") for s in listed]))
    if derived:
        year, number = tab.meta.get("year"), tab.meta.get("quarter")
        dated = detail.where("year IS NOT NULL").select("year", "quarter").distinct()
        if year is not None:
            out.append(_named(dated.where((F.col("year") != year) | (F.col("quarter") != number)), "the period is that of all dated rows", F.concat_ws(" ", "year", "quarter")))
        else:
            out.append(_named(dated.agg(F.count(F.lit(1)).alias("n")).where("n = 1"), "the period is open only if dates lie in several quarters", F.lit("period")))
    if unique:
        twice = detail.where(F.col(unique).isNotNull()).groupBy(unique).agg(F.count(F.lit(1)).alias("n")).where("n > 1")
        out.append(_named(twice, f"{unique} is unique", unique, F.col("n"), F.lit(1)))
    return _findings(out)


#: Levels of nesting that a snapshot may have.
DEPTH = 8
_TOTALS = {"step_cells": "running_total", "goal_cells": "cum_goal", "actual_cells": "cum_actual"}


def leaves(documents: DataFrame, depth: int = DEPTH) -> DataFrame:
    """Every scalar of JSON documents, opened level by level in Spark: (doc, parent, key, kind, num, txt); an element of a list has no key.

    documents: (path, document). A list or object below `depth` levels is a leaf of kind "deep".
    """
    spark = documents.sparkSession
    c = F.col
    level = documents.select(c("path").alias("doc"), F.lit("").alias("at"), F.try_parse_json("document").alias("v"))
    out = []
    for i in range(depth):
        kids = level.lateralJoin(spark.tvf.variant_explode(c("v").outer()))
        here = F.when(c("key").isNotNull(), F.concat("at", F.lit("."), "key")).otherwise(F.concat("at", F.lit("["), c("pos").cast("string"), F.lit("]")))
        kids = kids.select("doc", c("at").alias("parent"), "key", "value", here.alias("here"), F.schema_of_variant("value").alias("is"))
        nested = c("is").startswith("OBJECT") | c("is").startswith("ARRAY")
        kind = F.when(nested, "deep").when(c("is") == "BOOLEAN", "flag").when(c("is") == "STRING", "text").otherwise("number")
        number = F.when(c("is") == "BOOLEAN", F.try_variant_get("value", "$", "boolean").cast("double")).when(kind == "number", F.try_variant_get("value", "$", "double"))
        text = F.when(c("is") == "STRING", F.try_variant_get("value", "$", "string"))
        flat = kids if i == depth - 1 else kids.where(~nested)
        out.append(flat.select("doc", "parent", "key", kind.alias("kind"), number.alias("num"), text.alias("txt")))
        level = kids.where(nested).select("doc", c("here").alias("at"), c("value").alias("v"))
    return _all(out)


def claims(documents: DataFrame) -> DataFrame:
    """Every statement of snapshots about a cell: (doc, path, cell, kind, num, txt).

    `x` beside `x_cell`, or `value` beside `cell`, is a value; `x_formula` or `formula` is that cell's formula; a running total beside its
    list of cells is their sum, a row for each of them (kind "sum"). The keys of one object meet, never those of a document.
    """
    c = F.col
    every = leaves(documents)
    objects = every.where("key IS NOT NULL").groupBy("doc", "parent").agg(F.map_from_entries(F.collect_list(F.struct("key", F.struct("kind", "num", "txt")))).alias("m"))
    at = lambda k: F.try_element_at("m", k)
    one = objects.withColumn("key", F.explode(F.filter(F.map_keys("m"), lambda k: (k == "cell") | k.endswith("_cell"))))
    stem = F.when(c("key") == "cell", "value").otherwise(F.regexp_replace("key", "_cell$", ""))
    one = one.withColumns({"stem": stem, "cell": at(c("key"))["txt"]}).where(F.map_contains_key("m", c("stem")) & c("cell").isNotNull())
    one = one.withColumns({"said": at(c("stem")), "formula": at(F.when(c("key") == "cell", "formula").otherwise(F.concat("stem", F.lit("_formula"))))["txt"]})
    path = F.concat("parent", F.lit("."), "stem")
    values = one.select("doc", path.alias("path"), "cell", "said.kind", "said.num", "said.txt")
    formulas = one.where("formula IS NOT NULL").select("doc", path.alias("path"), "cell", F.lit("formula").alias("kind"), F.lit(None).cast("double").alias("num"), c("formula").alias("txt"))
    of = F.regexp_extract("parent", r"^(.*)\.(step_cells|goal_cells|actual_cells)$", 1), F.regexp_extract("parent", r"\.(step_cells|goal_cells|actual_cells)$", 1)
    listed = every.where("key IS NULL AND kind = 'text'").select("doc", of[0].alias("parent"), of[1].alias("list"), c("txt").alias("cell")).where("list <> ''")
    total = F.element_at(F.create_map(*[F.lit(x) for pair in _TOTALS.items() for x in pair]), c("list"))
    sums = listed.join(objects, ["doc", "parent"]).select("doc", F.concat("parent", F.lit("."), total).alias("path"), "cell", F.lit("sum").alias("kind"), at(total)["num"].alias("num"), F.lit(None).cast("string").alias("txt"))
    return _all([values, formulas, sums.where("num IS NOT NULL")])


def audit(documents: DataFrame, cells: DataFrame) -> DataFrame:
    """Statements of snapshots that their workbook's cells do not bear out, as (doc, check, subject, stored, expected).

    documents: (path, document, workbook), any number; cells: typed cells of all those workbooks.
    """
    c = F.col
    sheet = F.try_variant_get(F.try_parse_json("document"), "$.meta.sheet", "string")
    books = documents.select(c("path").alias("doc"), "workbook", sheet.alias("sheet"))
    said = claims(documents).join(books, "doc")
    held = cells.select("workbook", "sheet", c("ref").alias("cell"), c("num").alias("h_num"), c("txt").alias("h_txt"), c("flag").alias("h_flag"), c("formula").alias("h_formula"))
    j = said.join(held, ["workbook", "sheet", "cell"], "left")
    bound = F.greatest(F.lit(PROVENANCE), F.abs("num") * 1e-9)
    kind = c("kind")
    good = (
        F.when(kind == "number", F.when(c("num").isNull(), c("h_num").isNull()).otherwise(S.near("h_num", "num", bound)))
        .when(kind == "flag", F.coalesce("h_flag", F.lit(False)) == (c("num") != 0))
        .when(kind == "formula", c("h_formula") == c("txt"))
        .otherwise((c("h_txt") == F.trim("txt")) | (c("h_txt") == F.concat(F.trim("txt"), F.lit(":"))))  # a term's colon is not part of it
    )
    told = lambda rows, check, subject, stored, expected: rows.select("doc", F.lit(check).alias("check"), subject.alias("subject"), stored.cast("double").alias("stored"), expected.cast("double").alias("expected"))
    bad = told(j.where(kind != "sum").where(~F.coalesce(good, F.lit(False))), "a cell holds what is said of it", F.concat_ws(" ", "path", "cell", "kind"), c("num"), c("h_num"))
    sums = j.where(kind == "sum").groupBy("doc", "path", "num").agg(F.sum(F.coalesce("h_num", F.lit(0.0))).alias("total"))
    wrong = told(sums.where(~S.near("total", "num", bound)), "cells add up to the running total", c("path"), c("num"), c("total"))
    other = books.join(cells.select("workbook", "sheet").distinct(), ["workbook", "sheet"], "left_anti")
    return _all([bad, wrong, told(other, "the snapshot names its sheet", c("sheet"), F.lit(None), F.lit(None))])


def provenance(claims: DataFrame, cells: DataFrame) -> DataFrame:
    """Claims (cell, value) whose cell does not hold the value; cells: the typed cells of the sheet."""
    held = cells.select(F.col("ref").alias("cell"), F.col("num").alias("held"))
    j = claims.join(held, "cell", "left")
    bound = F.greatest(F.lit(PROVENANCE), F.abs("value") * 1e-9)
    return _fail(j, "a cited cell holds its value", "cell", "value", "held", bound)


def computed_provenance(lineage: DataFrame, cells: DataFrame, additive: Sequence[str]) -> DataFrame:
    """Sums (month_key, metric_key, value, runs) that their cited cells do not add up to."""
    one = lineage.where(F.col("metric_key").isin(*additive)).withColumn("cell", F.explode(cells_of("runs")))
    held = cells.select(F.col("ref").alias("cell"), F.col("num").alias("held"))
    sums = one.join(held, "cell", "left").groupBy("month_key", "metric_key", "value").agg(F.sum("held").alias("total"))
    return _fail(sums, "cited cells add up", F.concat_ws(" ", "month_key", "metric_key"), "value", "total", PROVENANCE)
