"""Reports of many workbooks as one job: the number of Spark jobs does not grow with the workbooks.

Cells of all workbooks are one table. Each workbook's head goes through one grouped function that returns layout rows
(`layout.of_workbook`); from there on everything is joins and groupings keyed by workbook: cells meet the layout by sheet and column, one
grouping makes a record of each row of each block, and the reconciliation is a table of rules that one grouped aggregate evaluates. A
workbook that is broken gets problems of its own and disturbs no other.

A group is a workbook's head (202 rows of each sheet) in the layout, and a block of a sheet (1,048,576 rows at most, by the file format) where
its rows are numbered. Rules, tabs and their specifications are fixed lists.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import cached_property, reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import semantics as S
from ..functions.semantics import MAX_CELLS, MAX_SCAN
from ..operators.discover import BELOW, Grid
from ..operators.reconcile import first_of
from ..sources.scratch import materialize
from .layout import FLAT, LAYOUT, NAMES, NUMBERS, STOPS, TABS, TITLES, Columns, FlatSpec, of_workbook

# The stored ratios that are checked, and the sections that print them.
P2P_CHECKS = (
    ("gross_cpa", "gross_spend", "ntl", "Gross CPA", "spend ÷ NTL"),
    ("immediate_roas", "immediate_raised", "gross_spend", "Immediate ROAS", "raised ÷ spend"),
    ("average_gift", "immediate_raised", "donors", "Average Gift", "raised ÷ donors"),
    ("donate_rate", "donors", "recipients", "Donate Rate", "donors ÷ recipients"),
    ("unsub_rate", "unsubs", "recipients", "Unsub Rate", "unsubs ÷ recipients"),
    ("ltv_roas_from_ntl", "ltv_from_ntl", "gross_spend", "LTV ROAS from NTL", "LTV from NTL ÷ spend"),
)
EMAIL_CHECKS = (
    ("average", "raised", "donors", "Average", "raised ÷ donors"),
    ("donate_rate", "donors", "recipients", "Donate Rate", "donors ÷ recipients"),
    ("action_rate", "actions", "recipients", "Action Rate", "actions ÷ recipients"),
    ("unsub_rate", "unsubs", "recipients", "Unsub Rate", "unsubs ÷ recipients"),
)
PAID_RETURNS = (("immediate_roas", "immediate_raised"), ("lifetime_roas", "lifetime_raised"), ("total_roas", "total_raised"))
PAID_SECTIONS = {"quarterly": ["pm-hero", "pm-quarter"], "monthly": ["pm-month"], "detail": ["pm-detail"]}

RULE = (
    "tab string, block string, rule_id string, check_ord int, part_ord int, stored string, numerator string, denominator string, floor double, relative double, "
    "needs_numerator boolean, needs_stored boolean, label string, means string, place string, found string, sections array<string>"
)


def rules() -> list[tuple]:
    """The ratio identities: stored = numerator / denominator within max(floor, relative * |expected|). Of digital, keys are those of a period."""
    digital = ("digital", "channel", "RC1", 0, 0, "pct", "actual", "goal", 1e-6, 0.0, True, True, "“% to goal”", "actual ÷ goal", "the Digital Report: they do not equal actual ÷ goal", "", ["s-hero", "s-channel"])
    out = [digital]
    for i, (block, sections) in enumerate(PAID_SECTIONS.items()):
        where = ("the Paid Media Report", "", sections)
        out.append(("paid", block, "RC3", 1, 10 * i, "gross_cpa", "gross_spend", "ntl", 0.02, 1e-6, True, False, "Gross CPA", "spend ÷ NTL", *where))
        out += [("paid", block, "RC4", 2, 10 * i + j, k, n, "gross_spend", 1e-6, 0.0, False, False, "ROAS", "raised ÷ spend", *where) for j, (k, n) in enumerate(PAID_RETURNS)]
    for tab, rule, checks, section in (("p2p", "RC9", P2P_CHECKS, "p2-detail"), ("email", "RC10", EMAIL_CHECKS, "es-detail")):
        out += [(tab, "detail", rule, 10 + i, 0, k, n, d, 0.02, 1e-6, True, False, label, means, TITLES[tab], f" of {TITLES[tab]}", [section]) for i, (k, n, d, label, means) in enumerate(checks)]
    return out


PROBLEM = "workbook string, tab string, level string, rule_id string, text string, sections array<string>, cells array<string>, more_cells int, emit_ord long"
#: Where what is noticed stands among the problems of a tab: its layout, its rows, ratios, sums.
AT_ROWS, AT_OVERALL, AT_CHECKS, AT_SUMS = 100_000, 200_000, 300_000, 400_000


def layouts(cells: DataFrame) -> DataFrame:
    """Rows of LAYOUT. cells: typed cells and the rows of kind "sheet" (`with_types`)."""
    filled = F.col("txt").isNotNull()
    cols = ["workbook", "sheet", "sheet_ord", "row", "col", "txt", "num", "flag", "formula"]
    deep = MAX_SCAN + BELOW
    head = cells.where((F.col("kind") == "sheet") | ((F.col("row") <= deep) & (filled | F.col("formula").isNotNull()))).select(*cols, F.lit(0).alias("filled"), F.lit(0).alias("worded"))
    last = lambda when: F.coalesce(F.max(F.when(when, F.col("row"))), F.lit(0))
    ends = cells.where(filled).groupBy("workbook", "sheet", "sheet_ord", "col").agg(last(filled).alias("filled"), last(F.col("num").isNull()).alias("worded"))
    none = {"row": F.lit(-1), "txt": F.lit(None).cast("string"), "num": F.lit(None).cast("double"), "flag": F.lit(None).cast("boolean"), "formula": F.lit(None).cast("string")}
    ends = ends.select(*[none[c].alias(c) if c in none else F.col(c) for c in cols], "filled", "worded")

    def of_group(frame: pd.DataFrame) -> pd.DataFrame:
        sheets = []
        frame = frame.sort_values(["sheet_ord", "row", "col"])
        for _, own in frame.groupby("sheet_ord", sort=True):
            grid, full, worded = {}, {}, {}
            for row, col, txt, num, flag, formula, f, w in own[["row", "col", "txt", "num", "flag", "formula", "filled", "worded"]].itertuples(index=False):
                if row < 0:
                    full[col], worded[col] = f, w
                elif row > 0:
                    grid[row, col] = {"row": row, "col": col, "txt": None if pd.isna(txt) else txt, "num": None if pd.isna(num) else float(num), "flag": bool(flag) if not pd.isna(flag) else False, "formula": None if pd.isna(formula) else formula}
            name = own["sheet"].iloc[0]
            sheets.append((name, Grid(name, grid), Columns(full, worded)))
        rows = of_workbook(frame["workbook"].iloc[0], sheets)
        return pd.DataFrame(rows, columns=NAMES).astype({"col": "Int32", "ord": "Int32", "head": "Int32", "num": "Float64"})

    return head.unionByName(ends).groupBy("workbook").applyInPandas(of_group, LAYOUT)


def with_types(cells: DataFrame) -> DataFrame:
    """Cells with txt, num and flag; the rows of kind "sheet" stay, without."""
    own = F.col("kind") != "sheet"
    return cells.withColumns({"txt": F.when(own, S.cell_text()), "num": F.when(own, S.cell_number()), "flag": F.when(own, S.cell_flag())})


def records(cells: DataFrame, layout: DataFrame) -> DataFrame:
    """A record for each row of each block: (workbook, tab, block, row, t, n, b, f): texts, numbers and formulas by key, and the keys of true flags."""
    fields = layout.where("kind = 'field'").select("workbook", "sheet", "tab", "block", "key", F.col("field").alias("what"), "col", "head", F.col("num").alias("stop"))
    c = F.col
    hits = cells.where("kind <> 'sheet'").select("workbook", "sheet", "row", "col", "txt", "num", "flag", "formula").join(fields, ["workbook", "sheet", "col"]).where("row > head")
    goes_on = F.when(c("stop") == STOPS["txt"], c("txt").isNotNull()).when(c("stop") == STOPS["num"], c("num").isNotNull())
    goes_on = goes_on.when(c("stop") == STOPS["channel"], c("txt").isNotNull() & ~S.norm("txt").rlike("^overall$")).otherwise(False)
    pairs = lambda when, value: F.map_from_entries(F.collect_list(F.when(when, F.struct("key", value))))  # noqa: E731  a row has as many keys as the sheet has columns, at most
    rows = hits.groupBy("workbook", "tab", "block", "head", "row").agg(
        pairs(c("txt").isNotNull(), c("txt")).alias("t"),
        pairs(c("num").isNotNull(), c("num")).alias("n"),
        F.collect_list(F.when((c("what") == "flag") & c("flag"), c("key"))).alias("b"),
        pairs(c("formula").isNotNull(), c("formula")).alias("f"),
        F.bool_or(goes_on).alias("goes_on"),
    )
    at = F.row_number().over(W.partitionBy("workbook", "tab", "block").orderBy("row"))
    return rows.where("goes_on").withColumn("at", at).where("row - head = at").drop("goes_on", "at", "head")


def _get(map_: str, key: Column | str) -> Column:
    return F.try_element_at(F.col(map_), F.lit(key) if isinstance(key, str) else key)


def shapes(layout: DataFrame) -> DataFrame:
    """A row for each tab of each workbook, bounded by the columns of a sheet: metrics in order, the column of each block's fields, periods, what runs in series, the chosen quarter."""
    c = F.col
    kind = lambda k: c("kind") == k
    metric = F.struct("ord", "key", "label", c("field").alias("kind"), "numerator", "denominator")
    period = F.struct(c("num").cast("int").alias("ord"), "key", "label", "col")
    return layout.groupBy("workbook", "tab").agg(
        F.bool_or(kind("problem") & (c("field") == "error")).alias("failed"),
        F.array_sort(F.collect_list(F.when(kind("metric"), metric))).alias("metrics"),
        F.map_from_entries(F.collect_list(F.when(kind("field"), F.struct(F.concat("block", F.lit("|"), "key"), "col")))).alias("cols"),
        F.array_sort(F.collect_list(F.when(kind("period"), period))).alias("periods"),
        F.collect_list(F.when(kind("series"), c("key"))).alias("series"),
        F.max(F.when(kind("meta") & (c("key") == "quarter"), F.floor(c("num") + 0.5).cast("int"))).alias("chosen"),
        F.bool_or(kind("field") & (c("block") == "overall")).alias("has_overall"),
    )


def _additive() -> Column:
    return F.filter("metrics", lambda m: S.is_additive(m["kind"]))


def flat_detail(rows: DataFrame, spec: FlatSpec, dims: Sequence[str] | None = None) -> DataFrame:
    """Detail rows of a flat tab with its fields as columns; dims: those that the sheet has (all, if not given)."""
    have = list(dict.fromkeys(spec.dims.values())) if dims is None else list(dims)
    read = {d: _get("n" if d in NUMBERS else "t", f"d:{d}") for d in have}
    read |= {d: F.array_contains("b", f"d:{d}") for d in have if d in spec.flags}
    own = rows.where((F.col("tab") == spec.name) & (F.col("block") == "detail")).withColumns(read)
    if "date" in have:
        own = own.withColumnRenamed("date", "date_serial").withColumn("date", S.serial_date("date_serial"))
    if spec.month_from_date:
        for name, made in (("year", F.year("date")), ("quarter", F.quarter("date")), ("month_num", F.month("date"))):
            given = F.col(name) if name in have else F.lit(None).cast("double")
            own = own.withColumn(name, given if dims is not None and name in have else F.coalesce(given, made.cast("double")))
        own = own.withColumn("month", S.month_label("date"))
    return own.withColumn("month_key", S.slug("month"))


class Reports:
    """The reports of all workbooks in a table of cells."""

    def __init__(self, cells: DataFrame, keep=None, one: bool = False):
        """keep: how the tables that all else reads are held, (rows, name) -> rows; the default writes them once. one: the cells are of a single workbook, whose layout may be broadcast."""
        keep = keep or materialize
        self.spark: SparkSession = cells.sparkSession
        self.source = cells
        self.cells = with_types(cells)
        self.layout = keep(layouts(self.cells), "layout")
        sent = F.broadcast if one else lambda x: x  # one workbook's columns are bounded by the file format
        self.rows = keep(records(self.cells, sent(self.layout.where("kind = 'field'"))), "records")
        self._shape = sent(keep(shapes(self.layout), "shapes"))

    # --- what is said of each workbook --------------------------------------------------------------------------

    @cached_property
    def shaped(self) -> DataFrame:
        """Records with the shape of their tab."""
        return self.rows.join(self._shape, ["workbook", "tab"])

    @cached_property
    def sound(self) -> DataFrame:
        """Those of the tabs whose layout is without errors."""
        return self.shaped.where("NOT failed")

    @cached_property
    def checks(self) -> DataFrame:
        """A row for each stored ratio that a rule applies to: expected, bad, and where it stands."""
        c = F.col
        rule = F.broadcast(self.spark.createDataFrame(rules(), RULE))  # a fixed list
        # a digital channel has its figures by period, other rows once
        once = F.array(F.struct(F.lit(0).alias("ord"), F.lit("").alias("key"), F.lit("").alias("label"), F.lit(0).alias("col")))
        own = self.sound.join(rule, ["tab", "block"]).withColumn("p", F.explode(F.when(c("tab") == "digital", c("periods")).otherwise(once)))
        key = lambda what: F.when(c("tab") == "digital", F.concat(F.lit("p:"), c("p.key"), F.lit(":"), c(what))).otherwise(F.concat(F.lit("m:"), c(what)))
        own = own.withColumns({f"k_{x}": key(x) for x in ("stored", "numerator", "denominator")})
        at = lambda k: F.try_element_at("cols", F.concat("block", F.lit("|"), c(k)))
        there = at("k_stored").isNotNull() & at("k_numerator").isNotNull() & at("k_denominator").isNotNull()
        own = own.where(there).select(
            "workbook", "tab", "rule_id", "check_ord", "part_ord", "row", c("p.ord").alias("period_ord"), "floor", "relative", "needs_numerator", "needs_stored", "label", "means", "place", "found", "sections",
            *[_get("n", c(f"k_{x}")).alias(x) for x in ("stored", "numerator", "denominator")],
            F.concat(S.column_letters(at("k_stored")), c("row").cast("string")).alias("cell"),
        )
        applies = S.truthy("denominator") & (~c("needs_numerator") | c("numerator").isNotNull()) & (~c("needs_stored") | c("stored").isNotNull())
        own = own.where(applies).withColumn("expected", S.ratio("numerator", "denominator"))
        return own.withColumn("bad", ~S.near("stored", "expected", F.greatest(c("floor"), F.abs("expected") * c("relative"))))

    @cached_property
    def checked(self) -> DataFrame:
        """For each check of each workbook: how many cells it saw, how many fail, the first of them and the sections that print those."""
        c = F.col
        key = ["workbook", "tab", "check_ord"]
        wrong = F.struct("part_ord", "sections")  # a dozen parts at most
        same = [F.first(x).alias(x) for x in ("rule_id", "label", "means", "place", "found")]
        n = self.checks.groupBy(*key).agg(*same, F.count(F.lit(1)).alias("n_checked"), F.count_if("bad").alias("n_bad"), F.array_sort(F.collect_set(F.when(c("bad"), wrong))).alias("parts"))
        bad = self.checks.where("bad").withColumn("text", S.bad_cell("cell", "stored", "expected"))
        cells = first_of(bad, key, ["part_ord", "row", "period_ord"], "text", "cells")
        sections = F.array_distinct(F.flatten(F.transform("parts", lambda p: p["sections"])))
        return n.join(cells, key, "left").withColumn("sections", sections).drop("parts")

    @cached_property
    def _paid_long(self) -> DataFrame:
        """(workbook, block, row, name, quarter, chosen, metric_ord, key, label, value) of the paid tab's additive metrics."""
        c = F.col
        name = F.trim(F.coalesce(_get("t", "d:label"), _get("t", "d:month")))
        quarter = F.floor(_get("n", "d:quarter") + 0.5).cast("int")
        one = self.sound.where("tab = 'paid'").select("workbook", "block", "row", name.alias("name"), quarter.alias("quarter"), "chosen", "n", F.explode(_additive()).alias("m"))
        return one.select("workbook", "block", "row", "name", "quarter", "chosen", c("m.ord").alias("metric_ord"), c("m.key").alias("key"), c("m.label").alias("label"), _get("n", F.concat(F.lit("m:"), c("m.key"))).alias("value"))

    @cached_property
    def sums(self) -> DataFrame:
        """Stored sums of the paid and digital tabs that their children do not make: (workbook, tab, level, rule_id, text, at). Parents and children meet in one window each."""
        c = F.col
        long = self._paid_long
        off = c("value").isNotNull() & ~S.near(F.coalesce("total", F.lit(0.0)), "value", F.when(c("key") == "ntl", 0.5).otherwise(0.05))
        money = lambda x: F.format_string("%.2f", F.coalesce(x, F.lit(0.0)))
        place = lambda o1, o2: (F.lit(AT_SUMS).cast("long") + F.lit(o1).cast("long") * 4096 + F.lit(o2)).alias("at") if isinstance(o1, int) else (F.lit(AT_SUMS).cast("long") + o1.cast("long") * 4096 + o2).alias("at")
        say = lambda rows, tab, level, rule, text, at: rows.select("workbook", F.lit(tab).alias("tab"), F.when(level, "error").otherwise("warn").alias("level"), rule.alias("rule_id"), text.alias("text"), at)
        of = lambda block: c("block") == block
        # months against their detail rows; a month without any is told once
        w = W.partitionBy("workbook", "name", "key")
        kids = [F.sum(F.when(of("detail"), c("value"))).over(w).alias("total"), F.count_if(of("detail")).over(w).alias("kids")]
        months = long.where(of("monthly") | of("detail")).where("name IS NOT NULL").select("*", *kids).where(of("monthly"))
        first = F.row_number().over(W.partitionBy("workbook", "row").orderBy("metric_ord")) == 1
        months = months.where((c("kids") == 0) | off).withColumn("first", first).where((c("kids") > 0) | c("first"))
        has = c("kids") > 0
        text = F.when(has, F.concat("name", F.lit(", "), "label", F.lit(": the month has "), money(c("value")), F.lit(", its rows "), money(c("total")), F.lit("."))).otherwise(F.concat("name", F.lit(" stands in the monthly table only.")))
        out = [say(months, "paid", has, F.when(has, "RC5").otherwise("RC6"), text, place(c("row"), c("metric_ord")))]
        # the first row of the chosen quarter against all months
        w = W.partitionBy("workbook", "key")
        chosen = F.min(F.when(of("quarterly") & (c("quarter") == c("chosen")), c("row"))).over(w)
        whole = long.where("block <> 'detail'").select("*", F.sum(F.when(of("monthly"), c("value"))).over(w).alias("total"), chosen.alias("at_row"))
        asked = whole.where(of("quarterly") & (c("row") == c("at_row"))).where(off)
        text = F.concat("label", F.lit(": Q"), "quarter", F.lit(" has "), money(c("value")), F.lit(", its months "), money(c("total")), F.lit("."))
        out.append(say(asked, "paid", F.lit(True), F.lit("RC7"), text, place(F.lit(1 << 30), c("metric_ord"))))
        own = self.channel_period.where("tab_sound AND actual IS NOT NULL")
        w = W.partitionBy("workbook", "period_key")
        both = own.withColumn("total", F.sum(F.when(of("channel"), c("actual"))).over(w)).where(of("overall") & (S.slug("channel") == "total_raised"))
        both = both.where("total IS NOT NULL").where(~S.near("total", "actual", 0.05))
        text = F.concat("label", F.lit(": Overall has "), money(c("actual")), F.lit(", its channels "), money(c("total")), F.lit("."))
        out.append(say(both, "digital", F.lit(True), F.lit("RC2"), text, place(c("period_ord"), c("row") % 4096)))
        return reduce(DataFrame.unionByName, out)

    @cached_property
    def channel_period(self) -> DataFrame:
        """The digital tabs' channels by period: goal, actual, percent, their cells and formulas."""
        c = F.col
        own = self.shaped.where("tab = 'digital'").withColumn("p", F.explode("periods"))
        made = []
        for i, f in enumerate(("goal", "actual", "pct")):
            key = F.concat(F.lit("p:"), c("p.key"), F.lit(f":{f}"))
            made += [_get("n", key).alias(f), F.concat(S.column_letters(c("p.col") + i), c("row").cast("string")).alias(f"{f}_cell"), _get("f", key).alias(f"{f}_formula")]
        raw = _get("t", F.concat(F.lit("p:"), c("p.key"), F.lit(":pct"))).alias("pct_raw")
        return own.select("workbook", "block", "row", _get("t", "d:channel").alias("channel"), c("p.key").alias("period_key"), c("p.ord").alias("period_ord"), c("p.label").alias("label"), *made, raw, (~c("failed")).alias("tab_sound"))

    @cached_property
    def profile(self) -> DataFrame:
        """A row for each tab of each workbook: what its rows are like, from one grouping."""
        c = F.col
        dated = c("tab").isin(*[s.name for s in FLAT.values() if s.month_from_date])
        date = S.serial_date(_get("n", "d:date"))
        quarters = F.when((c("tab") == "high_dollar") & date.isNotNull(), F.struct(F.year(date).alias("year"), F.quarter(date).alias("quarter")))
        count = lambda when: F.count_if(when)
        slices = sorted({s for spec in FLAT.values() for s in spec.slices})
        chosen = (c("block") == "quarterly") & (F.floor(_get("n", "d:quarter") + 0.5).cast("int") == c("chosen"))
        return self.shaped.groupBy("workbook", "tab").agg(
            F.first("failed").alias("failed"), F.first("chosen").alias("chosen"), F.first("has_overall").alias("has_overall"),
            *[count(c("block") == b).alias(f"n_{b}") for b in ("detail", "channel", "quarterly", "monthly")],
            F.min(F.when(c("block").isin("detail", "channel"), c("row"))).alias("a"), F.max(F.when(c("block").isin("detail", "channel"), c("row"))).alias("b"),
            *[count(_get("t", f"d:{s}").isNull()).alias(f"no_{s}") for s in slices],
            count(dated & date.isNull()).alias("no_date"),
            F.array_sort(F.collect_set(quarters)).alias("quarters"),
            count((c("block") == "detail") & (_get("t", "d:channel").isNull() | _get("t", "d:placement").isNull())).alias("no_place"),
            F.bool_or((c("block") == "overall") & (S.slug(_get("t", "d:channel")) == "total_raised")).alias("total_raised"),
            F.bool_or(chosen).alias("has_chosen"),
        )

    @cached_property
    def facts(self) -> DataFrame:
        """What the profile says in words: (workbook, tab, kind, level, rule_id, text, at)."""
        c = F.col
        lines = lambda *x: F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in x])
        said = []

        def say(when: Column, kind: str, level: str | None, text: Column, at: int, rule: str = "RC13") -> None:
            said.append(F.when(when, F.struct(F.lit(kind).alias("kind"), F.lit(level).cast("string").alias("level"), F.lit(rule).alias("rule_id"), text.alias("text"), F.lit(at).cast("long").alias("at"))))

        sound = ~c("failed")
        for spec in FLAT.values():
            own = sound & (c("tab") == spec.name)
            say(own, "finding", None, lines("Rows ", c("a"), " to ", c("b"), " give ", c("n_detail"), " detail rows."), AT_ROWS)
            for i, s in enumerate(spec.slices):
                say(own & (c(f"no_{s}") > 0), "problem", "warn", lines(f"The {s} is blank in ", c(f"no_{s}"), " detail rows."), AT_ROWS + 1 + i)
            if spec.month_from_date:
                say(own & (c("no_date") > 0), "problem", "warn", lines("The date cannot be read in ", c("no_date"), " detail rows."), AT_ROWS + 10)
            if not spec.labelled_period:
                named = F.transform("quarters", lambda p: lines("Q", p["quarter"], " ", p["year"]))
                size = F.size("quarters")
                say(own & (size == 1), "finding", None, lines("All dates lie in ", F.try_element_at(named, F.lit(1)), ", which is taken as the period."), AT_ROWS + 20)
                say(own & (size == 1), "period", None, F.array_join(F.transform("quarters", lambda p: lines(p["year"], " ", p["quarter"])), ","), AT_ROWS + 20)
                say(own & (size > 1), "problem", "warn", lines("The period is left open, as the dates lie in several quarters: ", F.array_join(named, ", "), "."), AT_ROWS + 20)
                say(own & (size == 0), "problem", "warn", lines("The period is left open, as no date can be read."), AT_ROWS + 20)
        digital, paid = c("tab") == "digital", c("tab") == "paid"
        say(digital & (c("n_channel") > 0), "finding", None, lines("Rows ", c("a"), " to ", c("b"), " give ", c("n_channel"), " channels."), AT_ROWS)
        say(digital & c("has_overall") & ~c("total_raised"), "problem", "error", lines("“Total Raised” is missing below “Overall”, so there are no headline figures."), AT_OVERALL)
        for i, b in enumerate(("quarterly", "monthly", "detail")):
            say(paid & (c(f"n_{b}") > 0), "finding", None, lines(f"The {b} table has ", c(f"n_{b}"), " rows."), AT_ROWS + i)
        say(sound & paid & (c("no_place") > 0), "problem", "warn", lines("Channel or placement is blank in ", c("no_place"), " detail rows."), AT_ROWS)
        say(sound & paid & c("chosen").isNotNull() & ~c("has_chosen"), "problem", "warn", lines("The quarterly table lacks Q", c("chosen"), "."), AT_SUMS + (1 << 50), "RC8")
        return self.profile.select("workbook", "tab", F.explode(F.array_compact(F.array(*said))).alias("x")).select("workbook", "tab", "x.*")

    @cached_property
    def told(self) -> DataFrame:
        """Problems, findings and derived periods of all workbooks: (kind, workbook, tab, level, rule_id, text, sections, cells, more_cells, at)."""
        c = F.col
        texts = F.array().cast("array<string>")
        common = lambda rows: rows.select("kind", "workbook", "tab", "level", "rule_id", "text", texts.alias("sections"), texts.alias("cells"), F.lit(0).alias("more_cells"), c("at").cast("long").alias("at"))
        laid = self.layout.where("kind IN ('problem', 'finding')").select("kind", "workbook", "tab", c("field").alias("level"), F.lit("RC13").alias("rule_id"), c("txt").alias("text"), c("ord").alias("at"))
        off = self.sums.withColumn("kind", F.lit("problem"))
        bad = c("n_bad") > 0
        flags = self.checked.select(
            F.when(bad, "problem").otherwise("finding").alias("kind"), "workbook", "tab", F.when(bad, "flag").alias("level"), "rule_id",
            F.when(bad, F.concat("label", F.lit(" is not "), "means", F.lit(" in "), "n_bad", F.lit(" of "), "n_checked", F.lit(" cells of "), "place", F.lit(".")))
            .otherwise(F.concat("label", F.lit(" holds in "), "n_checked", F.lit(" cells"), "found", F.lit("."))).alias("text"),
            F.when(bad, c("sections")).otherwise(texts).alias("sections"), F.coalesce("cells", texts).alias("cells"),
            F.greatest(F.lit(0), c("n_bad") - MAX_CELLS).cast("int").alias("more_cells"), (AT_CHECKS + c("check_ord")).cast("long").alias("at"),
        )
        return common(laid).unionByName(common(self.facts)).unionByName(common(off)).unionByName(flags)

    @cached_property
    def problems(self) -> DataFrame:
        """Rows of PROBLEM; emit_ord orders those of a workbook."""
        rank = F.element_at(F.create_map(*[F.lit(x) for i, t in enumerate(TABS) for x in (t.name, i)]), F.col("tab"))
        return self.told.where("kind = 'problem'").withColumn("emit_ord", rank.cast("long") * (1 << 56) + F.col("at")).select(*[x.strip().split(" ")[0] for x in PROBLEM.split(",")])

    @cached_property
    def findings(self) -> DataFrame:
        """(workbook, tab, text, at): what was found in order."""
        return self.told.where("kind = 'finding'").select("workbook", "tab", "text", "at")

    @property
    def published(self) -> DataFrame:
        """(workbook, tab) of each tab without an error."""
        tabs = self.layout.where("kind = 'tab'").select("workbook", "tab")
        return tabs.join(self.problems.where("level = 'error'").select("workbook", "tab").distinct(), ["workbook", "tab"], "left_anti")

    # --- figures -----------------------------------------------------------------------------------------------

    @cached_property
    def detail(self) -> DataFrame:
        """(workbook, tab, row, month_key, month, slices, n) of the flat tabs; slices: the value of each slice that the row has."""
        parts = []
        for spec in FLAT.values():
            d = flat_detail(self.sound, spec)
            slices = F.map_from_entries(F.array_compact(F.array(*[F.when(F.col(s).isNotNull(), F.struct(F.lit(s).alias("key"), F.col(s).alias("value"))) for s in spec.slices])))
            parts.append(d.select("workbook", "tab", "row", "month_key", "month", slices.alias("slices"), "n", "metrics", "series"))
        return reduce(DataFrame.unionByName, parts)

    @cached_property
    def values(self) -> DataFrame:
        """(workbook, tab, row, month_key, month, slices, metric_key, value) of the additive metrics of the flat tabs."""
        one = self.detail.withColumn("metric_key", F.explode(F.transform(_additive(), lambda m: m["key"])))
        return one.select("workbook", "tab", "row", "month_key", "month", "slices", "series", "metric_key", _get("n", F.concat(F.lit("m:"), F.col("metric_key"))).alias("value"))

    def rollup(self) -> DataFrame:
        """(workbook, tab, level, month_key, metric_key, value, row_count): by month and in all, with every ratio rebuilt from its sums."""
        c = F.col
        by = ["workbook", "tab", "level", "month_key"]
        both = self.values.withColumn("at", F.explode(F.array(F.struct(F.lit("total").alias("level"), F.lit("").alias("month_key")), F.struct(F.lit("month").alias("level"), c("month_key").alias("month_key")))))
        both = both.where("at.level = 'total' OR at.month_key <> ''").select("workbook", "tab", "at.level", "at.month_key", "metric_key", "value")
        sums = both.groupBy(*by, "metric_key").agg(F.sum("value").alias("value"), F.count(F.lit(1)).alias("row_count"))
        maps = sums.groupBy(*by).agg(F.map_from_entries(F.collect_list(F.struct("metric_key", "value"))).alias("v"), F.max("row_count").alias("row_count"))
        ratios = maps.join(self._shape, ["workbook", "tab"]).withColumn("m", F.explode(F.filter("metrics", lambda m: ~S.is_additive(m["kind"]))))
        at = lambda k: F.try_element_at(c("v"), c(f"m.{k}"))
        ratios = ratios.select(*by, c("m.key").alias("metric_key"), S.ratio(at("numerator"), at("denominator")).alias("value"), "row_count")
        return sums.unionByName(ratios)

    def lineage(self) -> DataFrame:
        """(workbook, tab, month_key, metric_key, col, first, last): the runs of cells behind each additive figure of a month."""
        from ..operators.lineage import runs

        own = self.layout.where("kind = 'field' AND block = 'detail' AND key LIKE 'm:%'").select("workbook", "tab", F.expr("substring(key, 3)").alias("metric_key"), S.column_letters("col").alias("letters"))
        cells = self.values.where("month_key <> ''").join(own, ["workbook", "tab", "metric_key"])
        by = ["workbook", "tab", "month_key", "metric_key"]
        return runs(cells.select(*by, F.concat("letters", F.col("row").cast("string")).alias("cell")), by)

    def series(self) -> DataFrame:
        """(workbook, tab, slice_type, slice_value, metric_key, month_key, period_ord, step, running_total) over every month of a tab."""
        from ..operators.series import series

        own = self.values.where("month_key <> ''").where(F.array_contains("series", F.col("metric_key")))
        cut = F.concat(F.array(F.struct(F.lit("all").alias("key"), F.lit("all").alias("value"))), F.map_entries("slices"))
        own = own.withColumn("s", F.explode(cut)).select("workbook", "tab", "month_key", "month", "row", "metric_key", "value", F.col("s.key").alias("slice_type"), F.col("s.value").alias("slice_value"))
        key = ["workbook", "tab", "slice_type", "slice_value", "metric_key"]
        sums = own.groupBy(*key, "month_key").agg(F.sum("value").alias("value"))
        months = own.groupBy("workbook", "tab", "month_key").agg(F.min("row").alias("period_ord"), F.min_by("month", "row").alias("label"))
        grid = own.select(*key).distinct().join(months, ["workbook", "tab"]).join(sums, [*key, "month_key"], "left")
        return series(grid, "value", key, "period_ord", "zero")

    def lists(self) -> DataFrame:
        """(workbook, tab, list, ord, value): choices of each slice by name; the digital tabs' channels, those at rest and the months to come."""
        from ..operators.series import dormant

        c = F.col
        parts = []
        one = self.detail.withColumn("s", F.explode(F.map_entries("slices"))).where("s.value <> ''").select("workbook", "tab", c("s.key").alias("list"), c("s.value").alias("value")).distinct()
        named = F.row_number().over(W.partitionBy("workbook", "tab", "list").orderBy(F.collate("value", "UNICODE")))
        parts.append(one.withColumn("ord", named))
        own = self.channel_period.where("block = 'channel'")
        quarter = own.where("period_key = 'quarter'").select("workbook", F.lit("digital").alias("tab"), F.col("row").alias("ord"), c("channel").alias("value"), dormant("goal", "actual").alias("rests"))
        parts.append(quarter.withColumn("list", F.lit("channels")).drop("rests"))
        parts.append(quarter.where("rests").withColumn("list", F.lit("dormant")).drop("rests"))
        months = own.where("period_key <> 'quarter'").groupBy("workbook", "period_key").agg(F.min("period_ord").alias("ord"), F.bool_and(c("actual").isNull()).alias("to_come")).where("to_come")
        parts.append(months.select("workbook", F.lit("digital").alias("tab"), F.lit("pending").alias("list"), "ord", c("period_key").alias("value")))
        return reduce(DataFrame.unionByName, parts)

    def documents(self) -> DataFrame:
        """(path, document, workbook): a JSON snapshot of each flat tab that may be published, for `sources.documents.publish`. A document holds what one tab holds."""
        c = F.col
        own = self.sound.where(c("tab").isin(*FLAT) & (c("block") == "detail")).join(self.published, ["workbook", "tab"]).withColumn("m", F.explode("metrics"))
        place = F.concat(S.column_letters(F.try_element_at("cols", F.concat(F.lit("detail|m:"), c("m.key")))), c("row").cast("string"))
        one = F.struct("row", c("m.key").alias("metric_key"), _get("n", F.concat(F.lit("m:"), c("m.key"))).alias("value"), place.alias("cell"))
        metrics = own.groupBy("workbook", "tab").agg(F.array_sort(F.collect_list(one)).alias("metrics"))
        figures = self.rollup().groupBy("workbook", "tab").agg(F.array_sort(F.collect_list(F.struct("level", "month_key", "metric_key", c("value").alias("figure"), "row_count"))).alias("rollup"))
        sheet = self.layout.where("kind = 'tab'").select("workbook", "tab", "sheet")
        whole = metrics.join(figures, ["workbook", "tab"]).join(sheet, ["workbook", "tab"])
        document = F.to_json(F.struct(F.struct("sheet", c("workbook").alias("source_workbook")).alias("meta"), "metrics", "rollup"), {"ignoreNullFields": "false"})
        path = F.concat(F.regexp_replace("workbook", "[^A-Za-z0-9._-]+", "_"), F.lit("/"), "tab", F.lit("-data.json"))
        return whole.select(path.alias("path"), document.alias("document"), "workbook")
