"""Queries through the whole path of a report, and the same results as SQL over the Parquet tables.

The tables become a workbook: orders and customers the P2P and digital tabs, lineitem the paid tab, orders by day the email tab, customers by nation
the donations. It is written as a file's bytes, read cell by cell, its tables are found, extracted, reconciled and verified. Amounts
are whole numbers, so sums do not depend on their order. `broken` is a twin with faults that must be found. A session keeps
the reports it has made, so that the queries share one pass.
"""

from __future__ import annotations

import json
import os
import tempfile
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..operators import discover, verify
from ..operators.discover import Sheet, typed
from ..operators.lineage import cells_of as spelled
from ..sources.scratch import materialize
from ..sources.snapshots import read_snapshot
from ..sources.workbook import CELLS, cells_of, split_ref, to_files
from .queries import table
from .report import Report, build
from .tabs import lineage

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str):
    def add(f):
        QUERIES[f.__name__] = f
        SQL[f.__name__] = sql
        return f

    return add


# --- a workbook from the tables -----------------------------------------------------------------------------------


def _cell(col: int, value: Column | None, kind: str = "number", formula: Column | None = None) -> Column:
    none = lambda t: F.lit(None).cast(t)
    v = none("string") if value is None else value
    empty = F.lit(value is None) if value is None else value.isNull()
    return F.struct(
        F.lit(col).alias("col"),
        F.when(empty, "blank").otherwise(kind).alias("kind"),
        (v.cast("double") if kind == "number" else none("double")).alias("v_num"),
        (v.cast("string") if kind in ("string", "error") else none("string")).alias("v_str"),
        (v.cast("boolean") if kind == "boolean" else none("boolean")).alias("v_bool"),
        (none("string") if formula is None else formula).alias("formula"),
    )


def _placed(rows: DataFrame, workbook: str, sheet: str, order: int, cells: list[Column]) -> DataFrame:
    """Cells of rows that have their `row`; a blank cell without a formula is left out."""
    one = rows.select("row", F.explode(F.array(*cells)).alias("c")).select("row", "c.*").where("kind <> 'blank' OR formula IS NOT NULL")
    return one.select(F.lit(workbook).alias("workbook"), F.lit(sheet).alias("sheet"), F.lit(order).alias("sheet_ord"), "row", "col", F.lit("").alias("ref"), "kind", "v_num", "v_str", "v_bool", "formula")


def _fixed(spark: SparkSession, workbook: str, sheet: str, order: int, cells: dict) -> DataFrame:
    out = [(workbook, sheet, order, 0, 0, "", "sheet", None, sheet, None, None)]
    for ref, value in cells.items():
        col, row = split_ref(ref)
        kind = "boolean" if isinstance(value, bool) else "number" if isinstance(value, (int, float)) else "string"
        out.append((workbook, sheet, order, row, col, "", kind, float(value) if kind == "number" else None, value if kind == "string" else None, value if kind == "boolean" else None, None))
    return spark.createDataFrame(out, CELLS)


def _heads(row: int, first: str, names: list) -> dict:
    from ..sources.workbook import column_letters, column_number

    return {f"{column_letters(column_number(first) + i)}{row}": n for i, n in enumerate(names) if n is not None}


def _month(day: str) -> Column:
    """0 to 2: the month's place in its quarter."""
    return (F.month(day) - 1) % 3


MONTHS = ("July", "August", "September")
_NAME = lambda i: F.element_at(F.array(*[F.lit(m) for m in MONTHS]), i + 1)
_FLOOR = lambda c: F.floor(c).cast("bigint")


def _when(n: Column, value: Column) -> Column:
    return F.when(n != 0, value)


def _p2p(spark, d: str, wb: str, sheet: str) -> DataFrame:
    o, c = table(spark, d, "orders"), table(spark, d, "customer")
    # customers grow with orders, so that neither side is sent whole to the driver and all executors
    j = o.join(c.hint("merge"), o.o_custkey == c.c_custkey, "left")
    done = F.col("o_orderstatus") == "F"
    rows = j.groupBy(_month("o_orderdate").alias("mi"), F.col("o_orderpriority").alias("topic"), F.coalesce("c_mktsegment", F.lit("none")).alias("audience")).agg(
        F.sum(_FLOOR("o_totalprice")).alias("spend"), F.count_if(F.col("o_orderstatus") == "O").alias("ntl"), F.coalesce(F.sum(F.when(done, _FLOOR("o_totalprice"))), F.lit(0)).alias("raised"), F.count_if(done).alias("donors")
    )
    rows = rows.withColumn("row", F.row_number().over(W.orderBy("mi", "topic", "audience")) + 4)  # 75 rows
    name = F.when(F.col("mi") == 1, "August ").otherwise(_NAME(F.col("mi")))
    cpa = _when(F.col("ntl"), F.col("spend") / F.col("ntl") + F.when(F.col("row") % 17 == 0, 1).otherwise(0))
    cells = [
        _cell(1, name, "string"),
        _cell(2, F.col("topic"), "string"),
        _cell(3, F.when(F.col("audience") != "MACHINERY", F.col("audience")), "string"),
        _cell(4, F.concat(F.lit(" $"), F.format_number("spend", 2)), "string"),
        _cell(5, F.col("ntl")),
        _cell(6, cpa, formula=F.concat(F.lit("=D"), F.col("row"), F.lit("/E"), F.col("row"))),
        _cell(7, F.col("raised")),
        _cell(8, F.col("donors")),
        _cell(9, _when(F.col("donors"), F.col("raised") / F.col("donors"))),
        _cell(10, F.lit(0.5)),
        _cell(11, F.concat(F.lit("code"), F.col("row")), "string"),
        _cell(12, F.lit(1)),
    ]
    last = rows.agg((F.max("row") + 2).alias("row")).where("row IS NOT NULL")
    heads = _heads(4, "A", ["Month", "Topic", "Audience", "Gross Spend", "NTL", "Gross CPA", "Immediate Raised", "Donors", "Average Gift", "Click Rate", "Source Code", "Helper 1"])
    fixed = _fixed(spark, wb, sheet, 2, {"A1": "Year:", "B1": 2026, "A2": "Quarter:", "B2": 3, **heads})
    return fixed.unionByName(_placed(rows, wb, sheet, 2, cells)).unionByName(_placed(last, wb, sheet, 2, [_cell(3, F.lit("a note"), "string")]))


P2P_SQL = """p0 AS (SELECT (month(o_orderdate) - 1) % 3 AS mi, o_orderpriority AS topic, coalesce(c_mktsegment, 'none') AS seg, CAST(sum(CAST(floor(o_totalprice) AS BIGINT)) AS DOUBLE) AS gross_spend,
 CAST(count(*) FILTER (WHERE o_orderstatus = 'O') AS DOUBLE) AS ntl, CAST(coalesce(sum(CAST(floor(o_totalprice) AS BIGINT)) FILTER (WHERE o_orderstatus = 'F'), 0) AS DOUBLE) AS immediate_raised, CAST(count(*) FILTER (WHERE o_orderstatus = 'F') AS DOUBLE) AS donors
 FROM orders LEFT JOIN customer ON o_custkey = c_custkey GROUP BY 1, 2, 3),
 p AS (SELECT *, CAST(row_number() OVER (ORDER BY mi, topic, seg) + 4 AS INT) AS row, (['July', 'August', 'September'])[CAST(mi AS INT) + 1] AS month, lower((['July', 'August', 'September'])[CAST(mi AS INT) + 1]) AS month_key, CASE WHEN seg <> 'MACHINERY' THEN seg END AS audience FROM p0)"""


def _day(c: str) -> Column:
    return F.date_diff(F.col(c).cast("date"), F.lit("1899-12-30").cast("date"))


def _email(spark, d: str, wb: str) -> DataFrame:
    done = F.col("o_orderstatus") == "F"
    rows = table(spark, d, "orders").groupBy(_day("o_orderdate").alias("serial")).agg(F.coalesce(F.sum(F.when(done, _FLOOR("o_totalprice"))), F.lit(0)).alias("raised"), F.count_if(done).alias("donors"), F.count(F.lit(1)).alias("recipients"))
    rows = rows.withColumn("row", F.row_number().over(W.orderBy("serial")) + 3)  # a row for each day
    s = F.col("serial")
    cells = [
        _cell(1, s), _cell(2, F.lit("9:00"), "string"), _cell(3, F.concat(F.lit("M"), s % 2), "string"), _cell(4, F.concat(F.lit("A"), s % 3), "string"), _cell(5, F.concat(F.lit("mail "), s), "string"),
        _cell(6, F.col("raised")), _cell(7, F.col("donors")), _cell(8, _when(F.col("donors"), F.col("raised") / F.col("donors"))), _cell(9, F.col("recipients")), _cell(10, F.col("donors") / F.col("recipients")), _cell(11, F.lit(0.25)),
    ]
    heads = _heads(3, "A", ["Date", "Send Time (ET)", "Mailing Topic", "Audience", "Label", "Raised", "Donors", "Average", "Recipients", "Donate Rate", "Open Rate"])
    fixed = _fixed(spark, wb, "Email Statistics", 3, {"A1": "Year:", "B1": 2026, "A2": "Quarter:", "B2": 3, **heads})
    return fixed.unionByName(_placed(rows, wb, "Email Statistics", 3, cells))


EMAIL_SQL = """e AS (SELECT date_diff('day', DATE '1899-12-30', CAST(o_orderdate AS DATE)) AS serial, CAST(o_orderdate AS DATE) AS date, CAST(coalesce(sum(CAST(floor(o_totalprice) AS BIGINT)) FILTER (WHERE o_orderstatus = 'F'), 0) AS DOUBLE) AS raised,
 CAST(count(*) FILTER (WHERE o_orderstatus = 'F') AS DOUBLE) AS donors, CAST(count(*) AS DOUBLE) AS recipients, CAST(row_number() OVER (ORDER BY CAST(o_orderdate AS DATE)) + 3 AS INT) AS row FROM orders GROUP BY CAST(o_orderdate AS DATE), 1)"""


def _high(spark, d: str, wb: str) -> DataFrame:
    n, c = table(spark, d, "nation"), table(spark, d, "customer")
    rows = c.join(F.broadcast(n), c.c_nationkey == n.n_nationkey, "left").groupBy(F.coalesce("c_nationkey", F.lit(-1)).alias("k"), "n_name", F.coalesce("c_mktsegment", F.lit("none")).alias("seg")).agg(F.sum(F.abs(_FLOOR("c_acctbal"))).alias("amount"))
    rows = rows.withColumn("row", F.row_number().over(W.orderBy("k", "seg")) + 4)  # a row for each nation and segment
    r = F.col("row")
    cells = [
        _cell(1, F.when(F.col("seg") != "FURNITURE", F.col("seg")), "string"), _cell(2, F.concat(F.lit("r"), r), "string"), _cell(3, F.lit(46204) + F.col("k")), _cell(4, F.col("amount")), _cell(5, F.col("n_name"), "string"),
        _cell(9, F.col("k") % 2 == 0, "boolean"), _cell(10, F.when(F.col("k") % 3 == 0, " true "), "string"),
    ]
    heads = _heads(4, "A", ["category", "receipt_id", "date", "amount", "fundraising_page", "first", "last", "email", "Finance Claim", "Authentic Added"])
    fixed = _fixed(spark, wb, "High-Dollar Donations", 4, {"A2": "a note", **heads})
    return fixed.unionByName(_placed(rows, wb, "High-Dollar Donations", 4, cells))


HIGH_SQL = """h0 AS (SELECT coalesce(c_nationkey, -1) AS k, n_name, coalesce(c_mktsegment, 'none') AS seg, CAST(sum(abs(CAST(floor(c_acctbal) AS BIGINT))) AS DOUBLE) AS amount FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey GROUP BY 1, 2, 3),
 h AS (SELECT *, CAST(row_number() OVER (ORDER BY k, seg) + 4 AS INT) AS row, CASE WHEN seg <> 'FURNITURE' THEN seg END AS category FROM h0)"""


def _digital(spark, d: str, wb: str, broken: bool) -> DataFrame:
    done = F.col("o_orderstatus") == "F"
    o = table(spark, d, "orders").withColumn("mi", _month("o_orderdate"))
    sums = [x for i in range(3) for x in (F.coalesce(F.sum(F.when(F.col("mi") == i, _FLOOR("o_totalprice"))), F.lit(0)).alias(f"g{i}"), F.coalesce(F.sum(F.when((F.col("mi") == i) & done, _FLOOR("o_totalprice"))), F.lit(0)).alias(f"a{i}"))]
    rows = o.groupBy(F.col("o_orderpriority").alias("channel")).agg(*sums)
    rest = spark.createDataFrame([("9-RESTING", 0, 0, 0, 0, 0, 0)], "channel string, g0 bigint, a0 bigint, g1 bigint, a1 bigint, g2 bigint, a2 bigint")
    rows = rows.unionByName(rest).withColumn("row", F.row_number().over(W.orderBy("channel")) + 13)  # a row for each priority
    r, c = F.col("row").cast("string"), F.col
    told = lambda i: F.when(c("channel") != "9-RESTING", c(f"a{i}")) if i < 2 else None  # noqa: E731  the last month is not reported yet
    goal, actual = c("g0") + c("g1") + c("g2"), c("a0") + c("a1")
    wrong = F.when(c("row") % 3 == 0, 0.01).otherwise(0.0)
    cells = [_cell(2, c("channel"), "string"), _cell(3, goal, formula=F.concat(F.lit("=SUM(Q"), r, F.lit(":S"), r, F.lit(")"))), _cell(4, actual, formula=F.concat(F.lit("='Quarterly Fundraising Toplines'!C"), r)), _cell(5, _when(goal, actual / goal + wrong))]
    for i in range(3):
        a = told(i)
        cells += [_cell(7 + 3 * i, c(f"g{i}"), formula=F.concat(F.lit("='Import - Monthly Goals'!B"), r)), _cell(8 + 3 * i, a, formula=F.concat(F.lit("='Monthly Fundraising Toplines'!C"), r))]
        cells += [_cell(9 + 3 * i, None if a is None else _when(c(f"g{i}"), a / c(f"g{i}")))]
        cells += [_cell(17 + i, c(f"g{i}"))]
    whole = rows.agg(F.max("row").alias("last"), *[F.sum(x).alias(x) for x in ("a0", "a1")])
    overall = whole.select((c("last") + 2).cast("int").alias("row"), "a0", "a1")
    raised = overall.withColumn("row", c("row") + 1)
    fault = 100 if broken else 0
    parts = [
        _fixed(spark, wb, "Digital Report", 0, {"B4": "Fundraising Toplines", "B6": "Client:", "C6": "Acme", "B7": "Email Lead:", "C7": "Lee", "B9": "Year:", "C9": 2026, "B10": "Quarter:", "C10": 3, "H2": "August", "I2": "TRUE", "B12": "Quarterly Toplines", "G12": "July", "J12": "August", "M12": "September",
            **_heads(13, "B", ["Channel", "Goal", "Actual", "% to Goal", None, *["Goal", "Actual", "% to Goal"] * 3])}),
        _placed(rows, wb, "Digital Report", 0, cells),
        _placed(overall, wb, "Digital Report", 0, [_cell(2, F.lit("Overall"), "string")]),
        _placed(raised, wb, "Digital Report", 0, [_cell(2, F.lit("Total Raised"), "string"), _cell(4, c("a0") + c("a1")), _cell(8, c("a0") + fault), _cell(11, c("a1"))]),
    ]
    return reduce(DataFrame.unionByName, parts)


DIGITAL_SQL = """o AS (SELECT o_orderpriority AS channel, (month(o_orderdate) - 1) % 3 AS mi, CAST(floor(o_totalprice) AS BIGINT) AS v, o_orderstatus = 'F' AS done FROM orders),
 c0 AS (SELECT channel, CAST(coalesce(sum(v) FILTER (WHERE mi = 0), 0) AS DOUBLE) AS g0, CAST(coalesce(sum(v) FILTER (WHERE mi = 1), 0) AS DOUBLE) AS g1, CAST(coalesce(sum(v) FILTER (WHERE mi = 2), 0) AS DOUBLE) AS g2,
 CAST(coalesce(sum(v) FILTER (WHERE mi = 0 AND done), 0) AS DOUBLE) AS a0, CAST(coalesce(sum(v) FILTER (WHERE mi = 1 AND done), 0) AS DOUBLE) AS a1 FROM o GROUP BY 1 UNION ALL SELECT '9-RESTING', 0, 0, 0, 0, 0),
 c AS (SELECT *, CAST(row_number() OVER (ORDER BY channel) + 13 AS INT) AS row FROM c0),
 t AS (SELECT row, channel, 'quarter' AS period_key, 0 AS period_ord, g0 + g1 + g2 AS goal, a0 + a1 AS actual, CASE WHEN g0 + g1 + g2 <> 0 THEN (a0 + a1) / (g0 + g1 + g2) + CASE WHEN row % 3 = 0 THEN 0.01::DOUBLE ELSE 0 END END AS pct, 'C' AS gc, 'D' AS ac, 'E' AS pc FROM c
 UNION ALL SELECT row, channel, 'july', 1, g0, CASE WHEN channel <> '9-RESTING' THEN a0 END, CASE WHEN g0 <> 0 THEN a0 / g0 END, 'G', 'H', 'I' FROM c
 UNION ALL SELECT row, channel, 'august', 2, g1, CASE WHEN channel <> '9-RESTING' THEN a1 END, CASE WHEN g1 <> 0 THEN a1 / g1 END, 'J', 'K', 'L' FROM c
 UNION ALL SELECT row, channel, 'september', 3, g2, NULL, NULL, 'M', 'N', 'O' FROM c)"""

PAID_HEADS = ["Gross Spend", "NTL", "Gross CPA", "Immediate Raised", "Immediate ROAS", "Lifetime Raised", "Lifetime ROAS", "Total Raised", "Total ROAS"]


def _paid_cells(bad: Column) -> list[Column]:
    """Columns F to N; bad: 1 where a stored ratio is wrong."""
    c = F.col
    both = c("now") + c("later") - c("n")  # names are counted once, so the total lies under its parts
    return [
        _cell(6, c("spend")), _cell(7, c("names")), _cell(8, _when(c("names"), c("spend") / c("names") + bad)), _cell(9, c("now")), _cell(10, _when(c("spend"), c("now") / c("spend"))),
        _cell(11, c("later")), _cell(12, _when(c("spend"), c("later") / c("spend") + bad)), _cell(13, both), _cell(14, _when(c("spend"), both / c("spend"))),
    ]


def _paid(spark, d: str, wb: str, broken: bool) -> DataFrame:
    c = F.col
    sums = [F.sum(_FLOOR(c("l_extendedprice") * c("l_discount"))).alias("spend"), F.sum(_FLOOR("l_quantity")).alias("names"), F.sum(_FLOOR(c("l_extendedprice") * c("l_tax"))).alias("now"), F.sum(_FLOOR("l_extendedprice")).alias("later")]
    li = table(spark, d, "lineitem").withColumn("mi", _month("l_shipdate"))
    by = li.groupBy("mi", "l_returnflag", "l_linestatus").agg(*sums, F.lit(1).alias("n"))
    detail = by.withColumn("row", F.row_number().over(W.orderBy("mi", "l_returnflag", "l_linestatus")) + 23)  # a row for each month and flags
    parts_ = ["spend", "names", "now", "later", "n"]
    add = lambda *k: by.groupBy(*k).agg(*[F.sum(x).alias(x) for x in parts_])
    month = add("mi")
    flags = add("l_returnflag").select(F.when(c("l_returnflag") == "A", 1).when(c("l_returnflag") == "N", 2).otherwise(4).alias("q"), *parts_)
    quarters = flags.unionByName(add().select(F.lit(3).alias("q"), *parts_)).withColumn("row", F.col("q") + 11)
    month = month.withColumn("row", (c("mi") + 18).cast("int"))
    sheet, none = "Paid Media Report", F.lit(0)
    heads = {**_heads(11, "B", ["Quarterly Toplines", None, None, "Quarter", *PAID_HEADS]), **_heads(17, "B", ["Monthly Toplines", None, None, "Month", *PAID_HEADS]), **_heads(23, "B", ["Month", "Channel", "Placement", "Goal", *PAID_HEADS])}
    fixed = {"B2": "Paid Media Report", "B4": "Year:", "C4": 2026, "B5": "Quarter:", "C5": 3, "B7": "Client:", "C7": "Acme", "F4": "NTL:", "G4": "Names that were new to the list", **heads}
    more = month.withColumn("spend", c("spend") + F.when(c("mi") == 0, 10).otherwise(0)) if broken else month
    # the month without rows has its label only
    parts = [
        _fixed(spark, wb, sheet, 1, fixed),
        _placed(quarters, wb, sheet, 1, [_cell(5, c("q")), *_paid_cells(none)]),
        _placed(more, wb, sheet, 1, [_cell(5, _NAME(c("mi").cast("int")), "string"), *_paid_cells(none)]),
        _fixed(spark, wb, sheet, 1, {"E21": "October", "F21": 0, "G21": 0}).where("kind <> 'sheet'"),
        _placed(detail, wb, sheet, 1, [_cell(2, _NAME(c("mi").cast("int")), "string"), _cell(3, c("l_returnflag"), "string"), _cell(4, c("l_linestatus"), "string"), _cell(5, F.lit("Acquisition"), "string"), *_paid_cells(F.when(c("row") % 5 == 0, 1).otherwise(0))]),
    ]
    return reduce(DataFrame.unionByName, parts)


PAID_SQL = """b AS (SELECT (month(l_shipdate) - 1) % 3 AS mi, l_returnflag AS channel, l_linestatus AS placement, CAST(sum(CAST(floor(l_extendedprice * l_discount) AS BIGINT)) AS DOUBLE) AS gross_spend, CAST(sum(CAST(floor(l_quantity) AS BIGINT)) AS DOUBLE) AS ntl,
 CAST(sum(CAST(floor(l_extendedprice * l_tax) AS BIGINT)) AS DOUBLE) AS immediate_raised, CAST(sum(CAST(floor(l_extendedprice) AS BIGINT)) AS DOUBLE) AS lifetime FROM lineitem GROUP BY 1, 2, 3),
 r0 AS (SELECT *, 1 AS n FROM b),
 det AS (SELECT *, CAST(row_number() OVER (ORDER BY mi, channel, placement) + 23 AS INT) AS row, (['July', 'August', 'September'])[CAST(mi AS INT) + 1] AS month FROM r0),
 mon AS (SELECT mi, sum(gross_spend) AS gross_spend, sum(ntl) AS ntl, sum(immediate_raised) AS immediate_raised, sum(lifetime) AS lifetime, count(*) AS n FROM b GROUP BY mi),
 q AS (SELECT CASE channel WHEN 'A' THEN 1 WHEN 'N' THEN 2 ELSE 4 END AS quarter, sum(gross_spend) AS gross_spend, sum(ntl) AS ntl, sum(immediate_raised) AS immediate_raised, sum(lifetime) AS lifetime, count(*) AS n FROM b GROUP BY 1
 UNION ALL SELECT 3, sum(gross_spend), sum(ntl), sum(immediate_raised), sum(lifetime), count(*) FROM b)"""

_KEPT: dict = {}


def _report(spark: SparkSession, d: str, broken: bool = False) -> Report:
    key = (spark.sparkContext.applicationId, d, broken)
    if key not in _KEPT:
        wb = "broken.xlsx" if broken else "report.xlsx"
        name = "My P2P Statistics 2026" if broken else "P2P Statistics"
        parts = [_digital(spark, d, wb, broken), _paid(spark, d, wb, broken), _p2p(spark, d, wb, name), *([] if broken else [_email(spark, d, wb)]), _high(spark, d, wb)]
        file = materialize(to_files(reduce(DataFrame.unionByName, parts)), "workbook")  # its bytes do not pass the driver
        _KEPT[key] = build(spark, cells_of(file), wb)
    return _KEPT[key]


def _folder(spark: SparkSession) -> str:
    """A folder for snapshots: the shared one, or a temporary one in a local session."""
    root = (spark.conf.get("spark.checkpoint.dir", None) or "").removeprefix("file:")
    if not root.startswith("/"):
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        root = tempfile.gettempdir()
    os.makedirs(root, exist_ok=True)
    return tempfile.mkdtemp(prefix="tallyloom-snapshots-", dir=root)


# --- reading ------------------------------------------------------------------------------------------------------


@query("""WITH c AS (SELECT *, CAST(row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) AS INT) AS row FROM customer),
 x AS (SELECT c_nationkey, row, 1 AS col, 'A' AS l, 'string' AS kind, CAST(NULL AS DOUBLE) AS v_num, c_name AS v_str, CAST(NULL AS BOOLEAN) AS v_bool, CAST(NULL AS VARCHAR) AS formula FROM c
 UNION ALL SELECT c_nationkey, row, 2, 'B', 'number', c_acctbal, NULL, NULL, NULL FROM c UNION ALL SELECT c_nationkey, row, 3, 'C', 'boolean', NULL, NULL, c_acctbal > 0, NULL FROM c
 UNION ALL SELECT c_nationkey, row, 4, 'D', 'error', NULL, '#N/A', NULL, NULL FROM c WHERE c_custkey % 10 = 0 UNION ALL SELECT c_nationkey, row, 28, 'AB', 'number', c_acctbal * 2, NULL, NULL, '=B' || row || '*$B$1+"B1"' FROM c
 UNION ALL SELECT c_nationkey, row, 30, 'AD', 'blank', NULL, NULL, NULL, '=SUM(A' || row || ':C' || (row + 1) || ')' FROM c)
 SELECT 'n' || c_nationkey || '.xlsx' AS workbook, 'Customers' AS sheet, row, CAST(col AS INT) AS col, l || row AS ref, kind, v_num, v_str, v_bool, formula FROM x""")
def wb_reader_cells(spark, d):
    """A workbook for each nation, written and read in tasks: strings, numbers, flags, errors, formulas that copy the one above."""
    c = table(spark, d, "customer").withColumn("row", F.row_number().over(W.partitionBy("c_nationkey").orderBy("c_custkey")))
    r = F.col("row").cast("string")
    cells = [
        _cell(1, F.col("c_name"), "string"),
        _cell(2, F.col("c_acctbal")),
        _cell(3, F.col("c_acctbal") > 0, "boolean"),
        _cell(4, F.when(F.col("c_custkey") % 10 == 0, "#N/A"), "error"),
        _cell(28, F.col("c_acctbal") * 2, formula=F.concat(F.lit("=B"), r, F.lit('*$B$1+"B1"'))),
        _cell(30, None, formula=F.concat(F.lit("=SUM(A"), r, F.lit(":C"), (F.col("row") + 1).cast("string"), F.lit(")"))),
    ]
    one = c.select("row", F.concat(F.lit("n"), "c_nationkey", F.lit(".xlsx")).alias("wb"), F.explode(F.array(*cells)).alias("c")).select("wb", "row", "c.*").where("kind <> 'blank' OR formula IS NOT NULL")
    made = one.select(F.col("wb").alias("workbook"), F.lit("Customers").alias("sheet"), F.lit(0).alias("sheet_ord"), "row", "col", F.lit("").alias("ref"), "kind", "v_num", "v_str", "v_bool", "formula")
    return cells_of(to_files(made)).where("kind <> 'sheet'").drop("sheet_ord")


@query("SELECT * FROM (VALUES (0, 'Digital Report'), (1, 'Paid Media Report'), (2, 'P2P Statistics'), (3, 'Email Statistics'), (4, 'High-Dollar Donations')) v(sheet_ord, sheet)")
def wb_sheets(spark, d):
    return _report(spark, d).cells.where("kind = 'sheet'").select("sheet_ord", "sheet")


@query(f"WITH {P2P_SQL}, n AS (SELECT CAST(count(*) AS INT) AS n FROM p) SELECT 4 AS header_row, 0 AS absent, 1 AS year_row, 2026.0::DOUBLE AS year, 'B2' AS quarter_cell, 12 AS max_col, n + 6 AS max_row, 12 AS n_headers, n AS block_rows, n + 4 AS block_end, 'B,D,E,F,G,H,I,J,L' AS numeric FROM n")
def wb_discovery(spark, d):
    """Where things are on the P2P sheet: the header, labels, extent, the block and its columns of numbers ("1-URGENT" begins with one)."""
    sheet = Sheet("P2P Statistics", typed(_report(spark, d).cells.where("sheet = 'P2P Statistics'")))
    row = sheet.header_row(["topic", "audience"])
    heads = sheet.headers(row, "A", "T")
    numbers = discover.numeric_columns(sheet, row, [h.col for h in heads])
    block = discover.block(sheet, row, [1, 2]).agg(F.count(F.lit(1)).cast("int").alias("n"), F.max("row").alias("last")).first()
    year, quarter = sheet.labelled("A", "B", "^year$"), sheet.labelled("A", "B", "^quarter$")
    letters = ",".join(h.letters for h in heads if numbers[h.col])
    facts = (row, sheet.find_row("A", "^nowhere$"), sheet.find_row("A", "^year$"), year["num"], quarter["cell"], sheet.max_col, sheet.max_row, len(heads), block["n"], block["last"], letters)
    return spark.createDataFrame([facts], "header_row int, absent int, year_row int, year double, quarter_cell string, max_col int, max_row int, n_headers int, block_rows int, block_end int, numeric string")


# --- the flat tabs ------------------------------------------------------------------------------------------------


@query(f"""WITH {P2P_SQL} SELECT row, month, month_key, topic, audience, gross_spend, ntl, CASE WHEN ntl <> 0 THEN gross_spend / ntl + CASE WHEN row % 17 = 0 THEN 1 ELSE 0 END END AS gross_cpa, immediate_raised, donors,
 CASE WHEN donors <> 0 THEN immediate_raised / donors END AS average_gift, 0.5::DOUBLE AS click_rate FROM p""")
def wb_p2p_detail(spark, d):
    return _report(spark, d).tabs["p2p"].tables["detail"].select("row", "month", "month_key", "topic", "audience", "gross_spend", "ntl", "gross_cpa", "immediate_raised", "donors", "average_gift", "click_rate")


@query("""SELECT * FROM (VALUES (0, 'gross_spend', 'Gross Spend', 'usd', 'D', true, '', ''), (1, 'ntl', 'NTL', 'count', 'E', true, '', ''), (2, 'gross_cpa', 'Gross CPA', 'usd2', 'F', false, 'gross_spend', 'ntl'), (3, 'immediate_raised', 'Immediate Raised', 'usd', 'G', true, '', ''),
 (4, 'donors', 'Donors', 'count', 'H', true, '', ''), (5, 'average_gift', 'Average Gift', 'usd2', 'I', false, 'immediate_raised', 'donors'), (6, 'click_rate', 'Click Rate', 'rate', 'J', false, '', '')) v(metric_ord, metric_key, label, kind, col, additive, numerator, denominator)""")
def wb_p2p_catalog(spark, d):
    return _report(spark, d).tabs["p2p"].tables["metric_catalog"].drop("unresolvable").fillna("", ["numerator", "denominator"])


_P2P_SUMS = "sum(gross_spend) AS gross_spend, sum(ntl) AS ntl, sum(immediate_raised) AS immediate_raised, sum(donors) AS donors, CASE WHEN sum(ntl) <> 0 THEN sum(gross_spend) / sum(ntl) END AS gross_cpa, CASE WHEN sum(donors) <> 0 THEN sum(immediate_raised) / sum(donors) END AS average_gift, count(*) AS row_count, string_agg(row, ',' ORDER BY row) AS rows"
_P2P_COLS = ("gross_spend", "ntl", "immediate_raised", "donors", "gross_cpa", "average_gift", "row_count")


def _rows(table_: DataFrame, *cols: str) -> DataFrame:
    return table_.select(*cols, F.array_join(F.col("rows").cast("array<string>"), ",").alias("rows"))


@query(f"WITH {P2P_SQL} SELECT month_key, min(row) AS first_row, min(month) AS label, {_P2P_SUMS}, count(*) FILTER (WHERE false) AS n_click_rate FROM p GROUP BY month_key")
def wb_p2p_monthly(spark, d):
    t = _report(spark, d).tabs["p2p"].tables["monthly"]
    n = F.when(F.col("click_rate").isNull(), 0).otherwise(1).cast("bigint")  # a ratio without components is blank
    return _rows(t.withColumn("n_click_rate", n), "month_key", "first_row", "label", *_P2P_COLS, "n_click_rate")


@query(f"WITH {P2P_SQL} SELECT {_P2P_SUMS} FROM p")
def wb_p2p_quarter(spark, d):
    return _rows(_report(spark, d).tabs["p2p"].tables["quarter_to_date"], *_P2P_COLS)


def _series_sql(base: str, keys: tuple[str, ...], slices: tuple[str, ...], name: str) -> str:
    names, values = ", ".join(f"'{k}'" for k in keys), ", ".join(keys)
    cut = "".join(f" UNION ALL SELECT month_key, '{s}', {s}, metric_key, value FROM u WHERE {s} IS NOT NULL" for s in slices)
    return f"""WITH {base}, u AS (SELECT month_key, {', '.join(slices)}, unnest([{names}]) AS metric_key, unnest([{values}]) AS value FROM {name}),
 w AS (SELECT month_key, 'all' AS slice_type, 'all' AS slice_value, metric_key, value FROM u{cut}), m AS (SELECT month_key, min(row) AS o FROM {name} GROUP BY 1),
 v AS (SELECT month_key, slice_type, slice_value, metric_key, sum(value) AS v FROM w GROUP BY ALL), k AS (SELECT DISTINCT slice_type, slice_value, metric_key FROM w)
 SELECT slice_type, slice_value, metric_key, month_key, coalesce(v, 0) AS step, sum(coalesce(v, 0)) OVER (PARTITION BY slice_type, slice_value, metric_key ORDER BY o) AS running_total
 FROM k CROSS JOIN m LEFT JOIN v USING (month_key, slice_type, slice_value, metric_key)"""


def _series(tab) -> DataFrame:
    return tab.tables["series"].select("slice_type", "slice_value", "metric_key", "month_key", "step", "running_total")


@query(_series_sql(P2P_SQL, ("gross_spend", "immediate_raised", "donors"), ("audience", "topic"), "p"))
def wb_p2p_series(spark, d):
    return _series(_report(spark, d).tabs["p2p"])


@query(f"""WITH {P2P_SQL}, u AS (SELECT month_key, row, unnest(['gross_spend', 'ntl', 'immediate_raised', 'donors']) AS metric_key, unnest([gross_spend, ntl, immediate_raised, donors]) AS value, unnest(['D', 'E', 'G', 'H']) || row AS cell FROM p),
 s AS (SELECT month_key, metric_key, sum(value) AS value, string_agg(cell, ',' ORDER BY row) AS cells FROM u GROUP BY 1, 2)
 SELECT * FROM s UNION ALL SELECT a.month_key, r.k, CASE WHEN b.value <> 0 THEN a.value / b.value END, a.cells || ',' || b.cells FROM (VALUES ('gross_cpa', 'gross_spend', 'ntl'), ('average_gift', 'immediate_raised', 'donors')) r(k, x, y) JOIN s a ON a.metric_key = r.x JOIN s b ON b.metric_key = r.y AND b.month_key = a.month_key""")
def wb_p2p_lineage(spark, d):
    return lineage(_report(spark, d).tabs["p2p"]).select("month_key", "metric_key", "value", F.array_join(spelled("runs"), ",").alias("cells"))


_MONTH_SQL = "strftime(date, '%B %Y') AS month"


@query(f"""WITH {EMAIL_SQL}, m AS (SELECT *, {_MONTH_SQL} FROM e) SELECT lower(replace(month, ' ', '_')) AS month_key, month AS label, min(row) AS first_row, sum(raised) AS raised, sum(donors) AS donors, sum(recipients) AS recipients,
 CASE WHEN sum(donors) <> 0 THEN sum(raised) / sum(donors) END AS average, sum(donors) / sum(recipients) AS donate_rate, count(*) AS row_count, string_agg(row, ',' ORDER BY row) AS rows FROM m GROUP BY month""")
def wb_email_monthly(spark, d):
    return _rows(_report(spark, d).tabs["email"].tables["monthly"], "month_key", "label", "first_row", "raised", "donors", "recipients", "average", "donate_rate", "row_count")


@query(f"WITH {EMAIL_SQL} SELECT row, CAST(date AS VARCHAR) AS day, CAST(serial AS DOUBLE) AS date_serial, CAST(year(date) AS DOUBLE) AS year, CAST(quarter(date) AS DOUBLE) AS quarter, CAST(month(date) AS DOUBLE) AS month_num, 'M' || serial % 2 AS topic, 'A' || serial % 3 AS audience, 'mail ' || serial AS label, raised FROM e")
def wb_email_detail(spark, d):
    return _report(spark, d).tabs["email"].tables["detail"].select("row", F.col("date").cast("string").alias("day"), "date_serial", "year", "quarter", "month_num", "topic", "audience", "label", "raised")


@query(_series_sql(EMAIL_SQL + ", em AS (SELECT *, lower(strftime(date, '%B_%Y')) AS month_key, 'A' || serial % 3 AS audience, 'M' || serial % 2 AS topic FROM e)", ("raised", "recipients", "donors"), ("audience", "topic"), "em"))
def wb_email_series(spark, d):
    return _series(_report(spark, d).tabs["email"])


@query(f"WITH {HIGH_SQL} SELECT row, category, 'r' || row AS receipt_id, amount, CAST(DATE '2026-07-01' + CAST(k AS INT) AS VARCHAR) AS day, n_name AS fundraising_page, k % 2 = 0 AS finance_claim, k % 3 = 0 AS authentic_added FROM h")
def wb_high_detail(spark, d):
    return _report(spark, d).tabs["high_dollar"].tables["detail"].select("row", "category", "receipt_id", "amount", F.col("date").cast("string").alias("day"), "fundraising_page", "finance_claim", "authentic_added")


@query(f"WITH {HIGH_SQL}, x AS (SELECT max(k) < 92 AND min(k) >= 0 AS one FROM h) SELECT sum(amount) AS amount, count(*) AS row_count, string_agg(row, ',' ORDER BY row) AS rows, 2026.0::DOUBLE AS year, 3.0::DOUBLE AS quarter FROM h")
def wb_high_quarter(spark, d):
    """The donations' total, with the period derived from their dates."""
    t = _report(spark, d).tabs["high_dollar"]
    return _rows(t.tables["quarter_to_date"], "amount", "row_count").withColumns({k: F.lit(t.meta[k]).cast("double") for k in ("year", "quarter")})


@query(_series_sql(HIGH_SQL + ", hm AS (SELECT *, 'july_2026' AS month_key FROM h)", ("amount",), ("category",), "hm"))
def wb_high_series(spark, d):
    return _series(_report(spark, d).tabs["high_dollar"])


@query(f"""WITH {P2P_SQL}, {EMAIL_SQL}, {HIGH_SQL} SELECT 'p2p' AS tab, 'audience' AS list, string_agg(DISTINCT audience, '|' ORDER BY audience) AS names FROM p UNION ALL SELECT 'p2p', 'topic', string_agg(DISTINCT topic, '|' ORDER BY topic) FROM p
 UNION ALL SELECT 'email', 'audience', string_agg(DISTINCT 'A' || serial % 3, '|' ORDER BY 'A' || serial % 3) FROM e UNION ALL SELECT 'high_dollar', 'category', string_agg(DISTINCT category, '|' ORDER BY category) FROM h""")
def wb_lists(spark, d):
    """Lists of choices, in order."""
    t = _report(spark, d).tabs
    rows = [(tab, name, "|".join(t[tab].lists[name])) for tab, name in (("p2p", "audience"), ("p2p", "topic"), ("email", "audience"), ("high_dollar", "category"))]
    return spark.createDataFrame(rows, "tab string, list string, names string")


# --- the digital and paid tabs ------------------------------------------------------------------------------------


@query(f"WITH {DIGITAL_SQL} SELECT row, channel, period_key, period_ord, goal, actual, pct, gc || row AS goal_cell, ac || row AS actual_cell, pc || row AS pct_cell, CASE period_key WHEN 'quarter' THEN '=SUM(Q' || row || ':S' || row || ')' ELSE '=''Import - Monthly Goals''!B' || row END AS goal_formula FROM t")
def wb_digital_table(spark, d):
    t = _report(spark, d).tabs["digital"].tables["channel_period"].where("block = 'channel'")
    return t.select("row", "channel", "period_key", "period_ord", "goal", "actual", "pct", "goal_cell", "actual_cell", "pct_cell", "goal_formula")


@query(f"""WITH {DIGITAL_SQL}, m AS (SELECT * FROM t WHERE period_ord > 0) SELECT row, channel, period_key, sum(goal) OVER w AS cum_goal, CASE WHEN actual IS NOT NULL THEN sum(actual) OVER w END AS cum_actual, actual IS NULL AS pending,
 string_agg(gc || row, ',') OVER w AS goal_cells FROM m WINDOW w AS (PARTITION BY row ORDER BY period_ord)""")
def wb_digital_series(spark, d):
    t = _report(spark, d).tabs["digital"].tables["series"]
    return t.select("row", "channel", "period_key", "cum_goal", "cum_actual", "pending", F.array_join("goal_cells", ",").alias("goal_cells"))


@query(f"WITH {DIGITAL_SQL} SELECT row, k.* FROM c, LATERAL (VALUES ('july', g0, 'Q' || row), ('august', g1, 'R' || row), ('september', g2, 'S' || row)) k(period_key, value, cell)")
def wb_digital_helpers(spark, d):
    return _report(spark, d).tabs["digital"].tables["helpers"].select("row", "period_key", "value", "cell")


@query(f"""WITH {DIGITAL_SQL} SELECT string_agg(channel, '|' ORDER BY row) AS channels, '9-RESTING' AS dormant, 'september' AS pending, 'august=I2' AS dynamic, 'Acme' AS client, 'Lee' AS lead, 2026.0::DOUBLE AS year, 3.0::DOUBLE AS quarter, 'Fundraising Toplines' AS title,
 'Monthly Fundraising Toplines' AS july_actual, 'Import - Monthly Goals' AS july_goal, 'Quarterly Fundraising Toplines' AS quarter_actual FROM c""")
def wb_digital_facts(spark, d):
    """Channels in order, the resting one, the month to come, toggles, labels, and the imports that formulas name."""
    t = _report(spark, d).tabs["digital"]
    on = "|".join(f"{x['month']}={x['cell']}" for x in t.lists["toggles"] if x["value"])
    row = {"channels": "|".join(t.lists["channels"]), "dormant": "|".join(t.lists["dormant"]), "pending": "|".join(t.lists["pending"]), "dynamic": on, **{k: t.meta[k] for k in ("client", "lead", "year", "quarter", "title")}}
    row |= {k: t.meta["sources"].get(k) for k in ("july_actual", "july_goal", "quarter_actual")}
    return spark.createDataFrame([tuple(row.values())], ", ".join(f"{k} {'double' if k in ('year', 'quarter') else 'string'}" for k in row))


_PAID_OUT = "gross_spend, ntl, immediate_raised, lifetime AS lifetime_raised, immediate_raised + lifetime - n AS total_raised"
_PAID_KEYS = ("gross_spend", "ntl", "immediate_raised", "lifetime_raised", "total_raised")


@query(f"WITH {PAID_SQL} SELECT row, month, channel, placement, {_PAID_OUT}, CASE WHEN ntl <> 0 THEN gross_spend / ntl + CASE WHEN row % 5 = 0 THEN 1 ELSE 0 END END AS gross_cpa FROM det")
def wb_paid_detail(spark, d):
    return _report(spark, d).tabs["paid"].tables["detail"].select("row", "month", "channel", "placement", *_PAID_KEYS, "gross_cpa")


@query(f"WITH {PAID_SQL} SELECT CAST(mi + 18 AS INT) AS row, (['July', 'August', 'September'])[CAST(mi AS INT) + 1] AS label, {_PAID_OUT} FROM mon UNION ALL SELECT 21, 'October', 0, 0, NULL, NULL, NULL")
def wb_paid_monthly(spark, d):
    return _report(spark, d).tabs["paid"].tables["monthly"].select("row", "label", *_PAID_KEYS)


@query(f"WITH {PAID_SQL} SELECT CAST(quarter + 11 AS INT) AS row, 'Q' || quarter AS label, {_PAID_OUT}, immediate_raised / gross_spend AS immediate_roas FROM q")
def wb_paid_quarterly(spark, d):
    return _report(spark, d).tabs["paid"].tables["quarterly"].select("row", "label", *_PAID_KEYS, "immediate_roas")


@query(f"""WITH {PAID_SQL}, s AS (SELECT sum(gross_spend) AS gross_spend, sum(ntl) AS ntl, sum(immediate_raised) AS immediate_raised, sum(lifetime) AS lifetime_raised, sum(immediate_raised + lifetime - n) AS total_raised FROM q)
 SELECT *, gross_spend / ntl AS gross_cpa, immediate_raised / gross_spend AS immediate_roas, lifetime_raised / gross_spend AS lifetime_roas, total_raised / gross_spend AS total_roas FROM s""")
def wb_paid_year(spark, d):
    return _report(spark, d).tabs["paid"].tables["year_to_date"].select(*_PAID_KEYS, "gross_cpa", "immediate_roas", "lifetime_roas", "total_roas")


@query(f"""WITH {PAID_SQL}, m AS (SELECT mi, gross_spend, ntl, immediate_raised + lifetime - n AS total_raised FROM mon UNION ALL SELECT 3, 0, 0, NULL),
 u AS (SELECT CAST(mi + 18 AS INT) AS row, unnest(['gross_spend', 'ntl', 'total_raised']) AS metric_key, unnest([gross_spend, ntl, total_raised]) AS step, unnest(['F', 'G', 'M']) AS l FROM m)
 SELECT row, metric_key, step, sum(coalesce(step, 0)) OVER w AS running_total, string_agg(l || row, ',') OVER w AS step_cells FROM u WINDOW w AS (PARTITION BY metric_key ORDER BY row)""")
def wb_paid_series(spark, d):
    t = _report(spark, d).tabs["paid"].tables["monthly_series"]
    return t.select("row", "metric_key", "step", "running_total", F.array_join("step_cells", ",").alias("step_cells"))


@query("SELECT 'NTL' AS term, 'Names that were new to the list' AS text, 'F4' AS term_cell, 'G4' AS text_cell")
def wb_paid_definitions(spark, d):
    return spark.createDataFrame([tuple(x[k] for k in ("term", "text", "term_cell", "text_cell")) for x in _report(spark, d).tabs["paid"].lists["definitions"]], "term string, text string, term_cell string, text_cell string")


# --- reconciliation -----------------------------------------------------------------------------------------------


@query(f"""WITH {P2P_SQL}, {DIGITAL_SQL}, {PAID_SQL},
 f AS (SELECT 'p2p' AS tab, 'RC9' AS rule_id, row, 'F' || row AS cell FROM p WHERE ntl <> 0 AND row % 17 = 0 UNION ALL SELECT 'digital', 'RC1', row, 'E' || row FROM t WHERE period_key = 'quarter' AND goal <> 0 AND row % 3 = 0
 UNION ALL SELECT 'paid', 'RC3', row, 'H' || row FROM det WHERE row % 5 = 0 UNION ALL SELECT 'paid', 'RC4', row, 'L' || row FROM det WHERE row % 5 = 0)
 SELECT tab, rule_id, 'flag' AS level, string_agg(cell, ',' ORDER BY row) FILTER (WHERE k <= 6) AS first_cells, CAST(greatest(count(*) - 6, 0) AS INT) AS more_cells FROM (SELECT *, row_number() OVER (PARTITION BY tab, rule_id ORDER BY row) AS k FROM f) GROUP BY tab, rule_id""")
def wb_flags(spark, d):
    """Stored ratios that are wrong: the first cells of each rule and how many more there are."""
    p = _report(spark, d).problems.where("level = 'flag'")
    first = F.array_join(F.transform("cells", lambda x: F.split(x, " ")[0]), ",")
    return p.select("tab", "rule_id", "level", first.alias("first_cells"), "more_cells")


@query("""SELECT * FROM (VALUES ('digital', 'warn', 'RC13', 1), ('digital', 'flag', 'RC1', 1), ('paid', 'warn', 'RC6', 1), ('paid', 'flag', 'RC3', 1), ('paid', 'flag', 'RC4', 1), ('p2p', 'warn', 'RC13', 2), ('p2p', 'flag', 'RC9', 1), ('email', 'warn', 'RC13', 1), ('high_dollar', 'warn', 'RC13', 1)) v(tab, level, rule_id, n)""")
def wb_problems(spark, d):
    return _report(spark, d).problems.groupBy("tab", "level", "rule_id").agg(F.count(F.lit(1)).cast("int").alias("n"))


@query("""SELECT * FROM (VALUES ('digital', 'error', 'RC2', 1), ('paid', 'error', 'RC5', 1), ('paid', 'error', 'RC7', 1), ('paid', 'warn', 'RC6', 1), ('p2p', 'warn', 'RC13', 3), ('email', 'error', 'RC13', 1)) v(tab, level, rule_id, n)""")
def wb_broken_problems(spark, d):
    """A total that its channels do not make, a month that its rows do not make, a renamed sheet and a missing one."""
    p = _report(spark, d, broken=True).problems.where("level <> 'flag' AND NOT (tab = 'digital' AND level = 'warn') AND tab <> 'high_dollar'")
    return p.groupBy("tab", "level", "rule_id").agg(F.count(F.lit(1)).cast("int").alias("n"))


@query("SELECT * FROM (VALUES ('p2p'), ('high_dollar')) v(tab)")
def wb_broken_published(spark, d):
    return _report(spark, d, broken=True).published


# --- verification -------------------------------------------------------------------------------------------------


def _verified(r: Report) -> DataFrame:
    t = r.tabs
    parts = [
        verify.digital(t["digital"]).withColumn("tab", F.lit("digital")),
        verify.paid(t["paid"]).withColumn("tab", F.lit("paid")),
        verify.flat(t["p2p"], required=("month", "topic"), unresolvable=("click_rate",)).withColumn("tab", F.lit("p2p")),
        verify.flat(t["email"], "label", ("month", "date", "audience", "topic", "label"), ("open_rate",)).withColumn("tab", F.lit("email")),
        verify.flat(t["high_dollar"], "receipt_id", ("receipt_id", "amount", "date"), (), ("amount",), True).withColumn("tab", F.lit("high_dollar")),
    ]
    return reduce(DataFrame.unionByName, parts).groupBy("tab", "check").agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH {DIGITAL_SQL} SELECT 'digital' AS tab, 'percent is actual over goal' AS \"check\", count(*) AS n FROM t WHERE period_key = 'quarter' AND goal <> 0 AND row % 3 = 0 HAVING count(*) > 0 UNION ALL SELECT 'paid', 'a month has detail rows', 1")
def wb_verified(spark, d):
    """Each tab computed a second way: only the faults that the workbook has are found."""
    return _verified(_report(spark, d))


@query("""SELECT * FROM (VALUES ('a month counts its own rows'), ('a month lists its own rows'), ('a series ends at its total'), ('detail rows sum to their month'), ('months sum to the quarter'), ('monthly: click_rate is blank, as its components are unknown'), ('monthly: gross_cpa is rebuilt'),
 ('the list of topic is that of the rows'), ('the quarter counts all rows'), ('the ratios without components are the known ones'), ('gross_spend is not negative'), ('topic is unique'), ('a detail row has its audience')) v("check")""")
def wb_verified_twin(spark, d):
    """A tab whose tables were tampered with: each check finds its fault."""
    from copy import copy

    tab = copy(_report(spark, d).tabs["p2p"])
    t = tab.tables = dict(tab.tables)
    tab.lists = {**tab.lists, "topic": [*tab.lists["topic"], "another"]}
    t["monthly"] = t["monthly"].withColumns({"gross_spend": F.col("gross_spend") * 1.01 + 1, "click_rate": F.lit(0.5), "rows": F.slice("rows", 2, 10**6), "row_count": F.col("row_count") + 1})
    t["quarter_to_date"] = t["quarter_to_date"].withColumn("row_count", F.col("row_count") + 1)
    t["series"] = t["series"].withColumn("running_total", F.col("running_total") * 1.01 + 1)
    t["detail"] = t["detail"].withColumn("gross_spend", F.when(F.col("row") == 5, -5.0).otherwise(F.col("gross_spend")))
    found = verify.flat(tab, "topic", ("audience",), (), ("gross_spend",))
    return found.select("check").distinct()


@query("""SELECT * FROM (VALUES ('percent is actual over goal'), ('months sum to the quarter'), ('channels sum to overall actual'), ('channels sum to overall goal'),
 ('average donation is raised over donations'), ('a helper holds its month''s goal'), ('helpers sum to the quarter''s goal')) v("check")""")
def wb_digital_twin(spark, d):
    """A digital tab that was tampered with: a month's actuals, a total's goal and mean, a helper. Each check finds its fault."""
    from copy import copy

    tab = copy(_report(spark, d).tabs["digital"])
    t = tab.tables = dict(tab.tables)
    more = lambda x: F.col(x) * 1.01 + 1
    table_ = t["channel_period"]
    july = (F.col("block") == "channel") & (F.col("period_key") == "july")
    table_ = table_.withColumn("actual", F.when(july, more("actual")).otherwise(F.col("actual")))
    total = table_.where("block = 'overall' AND period_key = 'quarter'").limit(1)
    goal = table_.where("block = 'channel' AND period_key = 'quarter'").agg(F.sum("goal").alias("g")).select((F.col("g") * 1.01 + 1).alias("goal"))
    own = table_.columns
    first = table_.where("block = 'overall'").withColumn("goal", F.lit(None).cast("double"))
    stated = total.drop("goal").crossJoin(goal).select(*own)
    rows = [table_.where("block = 'channel'"), first.where("period_key <> 'quarter'"), stated]
    for name, value in (("Total Donations", 10.0), ("Average Donation", 1.0)):
        rows.append(total.withColumn("channel", F.lit(name)).withColumn("actual", F.lit(value)).withColumn("goal", F.lit(None).cast("double")))
    t["channel_period"] = reduce(DataFrame.unionByName, rows)
    t["helpers"] = t["helpers"].withColumn("value", more("value"))
    return verify.digital(tab).select("check").distinct()


@query("""SELECT * FROM (VALUES ('year_to_date: gross_cpa is rebuilt'), ('gross_cpa is blank over zero'), ('quarterly: total raised is at most its parts'), ('monthly: total raised is at most its parts'),
 ('detail: total raised is at most its parts'), ('detail rows sum to their month'), ('a detail month has a monthly row'), ('a month has detail rows'), ('a detail row names its month, channel and placement'),
 ('months sum to the chosen quarter'), ('the quarter''s return holds for its months'), ('names are counted once in the chosen quarter, so its total is below its parts')) v("check")""")
def wb_paid_twin(spark, d):
    """A paid tab that was tampered with in its year, quarters, months and rows. Each check finds its fault."""
    from copy import copy

    tab = copy(_report(spark, d).tabs["paid"])
    t = tab.tables = dict(tab.tables)
    parts = F.col("immediate_raised") + F.col("lifetime_raised")
    t["year_to_date"] = t["year_to_date"].withColumn("gross_cpa", F.col("gross_cpa") * 1.01 + 1)
    # one quarter raises what its parts do, the others more
    t["quarterly"] = t["quarterly"].withColumn("total_raised", F.when(F.col("quarter") == 3, parts).otherwise(parts * 1.01 + 1))
    t["monthly"] = t["monthly"].withColumn("total_raised", parts * 1.01 + 1).withColumn("label", F.when(F.col("label") == "August", "Augst").otherwise(F.col("label")))
    first = F.col("row") == t["detail"].agg(F.min("row")).first()[0]
    broken = {"ntl": F.when(first, 0.0).otherwise(F.col("ntl")), "gross_cpa": F.when(first, 5.0).otherwise(F.col("gross_cpa")), "channel": F.when(~first, F.col("channel")), "total_raised": parts * 1.01 + 1}
    t["detail"] = t["detail"].withColumns(broken)
    return verify.paid(tab).select("check").distinct()


def _snapshots(spark, d: str) -> dict[str, str]:
    r = _report(spark, d)
    return dict(zip(r.shown, r.write(_folder(spark)), strict=True))


@query(f"""WITH {DIGITAL_SQL}, {P2P_SQL}, n AS (SELECT (SELECT count(*) FROM c) AS c, (SELECT count(*) FROM p) AS p, (SELECT count(*) FROM orders) AS o)
 SELECT 'digital' AS tab, 12 * c + 12 + 3 * c + 1 AS n_values, 0 AS n_wrong FROM n UNION ALL SELECT 'p2p', 7 * p, 0 FROM n""")
def wb_audit(spark, d):
    """Every statement of the written snapshots about a cell, against the cells, all snapshots at once."""
    r = _report(spark, d)
    docs = _documents(spark, d, "digital", "p2p")
    n = verify.claims(docs).where("kind IN ('number', 'flag', 'text')").groupBy("doc").agg(F.count(F.lit(1)).alias("n_values"))
    wrong = verify.audit(docs, typed(r.cells)).groupBy("doc").agg(F.count(F.lit(1)).alias("n_wrong"))
    return n.join(wrong, "doc", "left").select(F.col("doc").alias("tab"), "n_values", F.coalesce("n_wrong", F.lit(0)).alias("n_wrong"))


def _book(spark, d: str) -> str:
    return _report(spark, d).cells.select("workbook").first()["workbook"]


def _documents(spark, d: str, *tabs: str) -> DataFrame:
    """(path, document, workbook) of written snapshots, named by their tab."""
    paths, book = _snapshots(spark, d), F.lit(_book(spark, d)).alias("workbook")
    parts = [spark.read.text(paths[t], wholetext=True).select(F.lit(t).alias("path"), F.col("value").alias("document"), book) for t in tabs]
    return reduce(DataFrame.unionByName, parts)


@query(f"WITH {PAID_SQL}, n AS (SELECT count(*) AS n FROM det) SELECT 'a cell holds what is said of it' AS \"check\", 9 * n + 1 AS n FROM n UNION ALL SELECT 'cells add up to the running total', 12 UNION ALL SELECT 'the snapshot names its sheet', 1")
def wb_audit_twin(spark, d):
    """A snapshot with other figures and another term's text, and one with another sheet's name: each is found."""
    s = json.loads(_documents(spark, d, "paid").first()["document"])
    for x in s["detail_metrics"]:
        x["value"] = (x["value"] or 0) * 1.01 + 1  # beyond the bound, which grows with the value
    for x in s["monthly_series"]:
        x["running_total"] = x["running_total"] * 1.01 + 1
    s["definitions"][0]["text"] = "something else"
    other = {"meta": {"sheet": "Another"}}
    docs = spark.createDataFrame([("paid", json.dumps(s), _book(spark, d)), ("other", json.dumps(other), _book(spark, d))], "path string, document string, workbook string")
    wrong = verify.audit(docs, typed(_report(spark, d).cells))
    return wrong.groupBy("check").agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH {P2P_SQL} SELECT 'P2P Statistics' AS sheet, 'report.xlsx' AS source_workbook, sum(gross_spend) AS gross_spend, count(*) AS n_rows, true AS has_build_time FROM p")
def wb_snapshot(spark, d):
    """A written snapshot, read back as a table."""
    s = read_snapshot(spark, _snapshots(spark, d)["p2p"])
    return s.select("meta.sheet", "meta.source_workbook", F.col("quarter_to_date")[0]["gross_spend"].alias("gross_spend"), F.size("detail").cast("bigint").alias("n_rows"), F.col("meta.built_at").isNotNull().alias("has_build_time"))
