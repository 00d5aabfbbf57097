"""Queries over very many workbooks at once, and the same results as SQL over the Parquet tables.

Orders become a workbook for each hundredth part of the customers, with a P2P and a paid tab, written as files and read again in tasks. The
parts differ in their faults: a renamed or missing tab, a header that is not there, ratios and sums that are wrong, a quarter
without a row, columns that lie elsewhere. All reports come out of one plan (`many.Reports`).
"""

from __future__ import annotations

import io
import zipfile
from functools import reduce
from xml.sax.saxutils import escape

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..operators import verify
from ..sources.documents import publish
from ..sources.scratch import materialize, scratch_path
from ..sources.workbook import cells_of, cells_or_problems, column_letters, column_number, to_files
from .many import Reports
from .queries import table
from .workbook_queries import MONTHS, _cell, _when

QUERIES: dict = {}
SQL: dict[str, str] = {}
PARTS = 100
_KEPT: dict = {}


def query(sql: str):
    def add(f):
        QUERIES[f.__name__] = f
        SQL[f.__name__] = sql
        return f

    return add


# Rows of the P2P tab, by workbook k: k % 5 = 1 lacks it, 2 has it renamed, 3 has no header; of the paid tab: k % 4 = 0 has 10 too much in July's
# spend, k % 6 = 0 no row of its quarter, k % 7 = 0 a month without rows, k % 3 = 0 the monthly columns one further to the right.
BASE_SQL = """o AS (
  SELECT o_custkey % 100 AS k, (month(o_orderdate) - 1) % 3 AS mi, o_orderpriority AS topic, o_orderstatus AS status,
         CAST(floor(o_totalprice) AS BIGINT) AS v
  FROM orders),
p AS (
  SELECT k, mi, topic, CAST(sum(v) AS DOUBLE) AS gross_spend, CAST(count(*) FILTER (WHERE status = 'O') AS DOUBLE) AS ntl,
         CAST(coalesce(sum(v) FILTER (WHERE status = 'F'), 0) AS DOUBLE) AS immediate_raised,
         CAST(count(*) FILTER (WHERE status = 'F') AS DOUBLE) AS donors,
         lower((['July', 'August', 'September'])[CAST(mi AS INT) + 1]) AS month_key,
         CAST(row_number() OVER (PARTITION BY k ORDER BY mi, topic) + 4 AS INT) AS row
  FROM o GROUP BY k, mi, topic),
d AS (
  SELECT k, mi, status AS channel, CAST(sum(v) AS DOUBLE) AS spend, CAST(count(*) AS DOUBLE) AS ntl,
         CAST(row_number() OVER (PARTITION BY k ORDER BY mi, status) + 23 AS INT) AS row
  FROM o GROUP BY k, mi, status),
m AS (SELECT k, mi, sum(spend) AS spend, sum(ntl) AS ntl FROM d GROUP BY k, mi),
books AS (SELECT DISTINCT k, 'part' || k || '.xlsx' AS workbook FROM o)"""


def _sheet(rows: DataFrame, sheet, order: int, cells) -> DataFrame:
    one = rows.select("k", "row", F.explode(F.array(*cells)).alias("c")).select("k", "row", "c.*").where("kind <> 'blank' OR formula IS NOT NULL")
    return one.select("k", F.lit(sheet).alias("sheet") if isinstance(sheet, str) else sheet.alias("sheet"), F.lit(order).alias("sheet_ord"), "row", "col", "kind", "v_num", "v_str", "v_bool", "formula")


def _labels(row: int, first: str, names) -> dict[str, object]:
    return {f"{column_letters(column_number(first) + i)}{row}": n for i, n in enumerate(names) if n is not None}


def _written(books: DataFrame, sheet, order: int, labels: dict) -> DataFrame:
    """The same labels in each of the workbooks."""
    rows = []
    for ref, value in labels.items():
        at = column_number("".join(x for x in ref if x.isalpha()))
        number = isinstance(value, (int, float))
        rows.append((int("".join(x for x in ref if x.isdigit())), at, "number" if number else "string", float(value) if number else None, None if number else value))
    one = books.crossJoin(F.broadcast(books.sparkSession.createDataFrame(rows, "row int, col int, kind string, v_num double, v_str string")))  # a few dozen labels
    name = F.lit(sheet) if isinstance(sheet, str) else sheet
    return one.select("k", name.alias("sheet"), F.lit(order).alias("sheet_ord"), "row", "col", "kind", "v_num", "v_str", F.lit(None).cast("boolean").alias("v_bool"), F.lit(None).cast("string").alias("formula"))


def _cells(spark, d: str) -> DataFrame:
    c = F.col
    o = table(spark, d, "orders").select(
        (c("o_custkey") % PARTS).alias("k"), ((F.month("o_orderdate") - 1) % 3).alias("mi"), c("o_orderpriority").alias("topic"), c("o_orderstatus").alias("status"), F.floor("o_totalprice").cast("bigint").alias("v")
    )
    books = o.select("k").distinct()
    name = lambda mi: F.element_at(F.array(*[F.lit(m) for m in MONTHS]), mi + 1)
    done = c("status") == "F"
    p2p = o.groupBy("k", "mi", "topic").agg(F.sum("v").alias("spend"), F.count_if(c("status") == "O").alias("ntl"), F.coalesce(F.sum(F.when(done, c("v"))), F.lit(0)).alias("raised"), F.count_if(done).alias("donors"))
    p2p = p2p.where("k % 5 <> 1").withColumn("row", F.row_number().over(W.partitionBy("k").orderBy("mi", "topic")) + 4)
    title = F.when(c("k") % 5 == 2, "Our P2P Statistics").otherwise("P2P Statistics")
    wrong = F.when(c("row") % 4 == 0, 1_000_000).otherwise(0)
    p2p_cells = [
        _cell(1, name(c("mi")), "string"),
        _cell(2, c("topic"), "string"),
        _cell(3, F.lit("everyone"), "string"),
        _cell(4, c("spend")),
        _cell(5, c("ntl")),
        _cell(6, _when(c("ntl"), c("spend") / c("ntl") + wrong)),
        _cell(7, c("raised")),
        _cell(8, c("donors")),
    ]
    heads = _labels(4, "A", ["Month", "Topic", "Audience", "Gross Spend", "NTL", "Gross CPA", "Immediate Raised", "Donors"])
    some = books.where("k % 5 <> 1")
    parts = [_sheet(p2p, title, 0, p2p_cells), _written(some, title, 0, {"A1": "Year:", "B1": 2026, "A2": "Quarter:", "B2": 3}), _written(some.where("k % 5 <> 3"), title, 0, heads)]
    detail = o.groupBy("k", "mi", "status").agg(F.sum("v").alias("spend"), F.count(F.lit(1)).alias("ntl"))
    month = detail.groupBy("k", "mi").agg(F.sum("spend").alias("spend"), F.sum("ntl").alias("ntl"))
    whole = month.groupBy("k").agg(F.sum("spend").alias("spend"), F.sum("ntl").alias("ntl")).withColumn("row", F.lit(12))
    detail = detail.withColumn("row", F.row_number().over(W.partitionBy("k").orderBy("mi", "status")) + 23)
    month = month.withColumn("row", (c("mi") + 18).cast("int"))
    sheet = "Paid Media Report"
    extra = F.when((c("k") % 4 == 0) & (c("mi") == 0), 10).otherwise(0)
    moved, plain = month.where("k % 3 = 0"), month.where("k % 3 <> 0")
    quarter = F.when(c("k") % 6 == 0, 2).otherwise(3)
    figures = lambda first, spend: [_cell(first, spend), _cell(first + 1, c("ntl"))]
    parts += [
        _written(books, sheet, 1, {"B4": "Year:", "C4": 2026, "B5": "Quarter:", "C5": 3, "F4": "NTL:", "G4": "Names that were new to the list", **_labels(11, "B", ["Quarterly Toplines", None, None, "Quarter", "Gross Spend", "NTL"])}),
        _written(books, sheet, 1, {"B17": "Monthly Toplines", "E17": "Month", **_labels(23, "B", ["Month", "Channel", "Placement", "Goal", "Gross Spend", "NTL"])}),
        _written(books.where("k % 3 <> 0"), sheet, 1, _labels(17, "F", ["Gross Spend", "NTL"])),
        _written(books.where("k % 3 = 0"), sheet, 1, _labels(17, "G", ["Gross Spend", "NTL"])),
        _written(books.where("k % 7 = 0"), sheet, 1, {"E21": "October"}),
        _sheet(whole, sheet, 1, [_cell(5, quarter), *figures(6, c("spend"))]),
        _sheet(plain, sheet, 1, [_cell(5, name(c("mi")), "string"), *figures(6, c("spend") + extra)]),
        _sheet(moved, sheet, 1, [_cell(5, name(c("mi")), "string"), *figures(7, c("spend") + extra)]),
        _sheet(detail, sheet, 1, [_cell(2, name(c("mi")), "string"), _cell(3, c("status"), "string"), _cell(4, F.lit("web"), "string"), *figures(6, c("spend"))]),
    ]
    out = reduce(DataFrame.unionByName, parts)
    return out.select(F.concat(F.lit("part"), c("k").cast("string"), F.lit(".xlsx")).alias("workbook"), "sheet", "sheet_ord", "row", "col", F.lit("").alias("ref"), "kind", "v_num", "v_str", "v_bool", "formula")


def _reports(spark, d: str) -> Reports:
    """Kept for the session, as written tables."""
    key = (spark.sparkContext.applicationId, d)
    if key not in _KEPT:
        _KEPT[key] = Reports(materialize(cells_of(to_files(_cells(spark, d))), "cells"))
    return _KEPT[key]


@query(f"""WITH {BASE_SQL},
q AS (SELECT * FROM p WHERE k % 5 NOT IN (1, 3)),
l AS (SELECT k, 'month' AS level, month_key, * EXCLUDE (k, month_key) FROM q UNION ALL SELECT k, 'total', '', * EXCLUDE (k, month_key) FROM q),
s AS (
  SELECT k, level, month_key, sum(gross_spend) AS gross_spend, sum(ntl) AS ntl, sum(immediate_raised) AS immediate_raised,
         sum(donors) AS donors, count(*) AS row_count
  FROM l GROUP BY k, level, month_key)
SELECT 'part' || k || '.xlsx' AS workbook, level, month_key, metric_key, value, row_count
FROM s, LATERAL (VALUES ('gross_spend', gross_spend), ('ntl', ntl), ('immediate_raised', immediate_raised), ('donors', donors),
  ('gross_cpa', CASE WHEN ntl <> 0 THEN gross_spend / ntl END)) v(metric_key, value)""")
def wb_many_rollup(spark, d):
    """Sums and rebuilt ratios of each workbook, by month and in all."""
    return _reports(spark, d).rollup().select("workbook", "level", "month_key", "metric_key", "value", "row_count")


@query(f"""WITH {BASE_SQL},
u AS (
  SELECT k, month_key, row, c.metric_key, c.col
  FROM p, LATERAL (VALUES ('gross_spend', 'D'), ('ntl', 'E'), ('immediate_raised', 'G'), ('donors', 'H')) c(metric_key, col)
  WHERE k % 5 NOT IN (1, 3)),
i AS (SELECT *, row - row_number() OVER (PARTITION BY k, month_key, metric_key ORDER BY row) AS island FROM u)
SELECT 'part' || k || '.xlsx' AS workbook, month_key, metric_key, col || min(row) || ':' || col || max(row) AS cells, count(*) AS n_cells
FROM i GROUP BY k, month_key, metric_key, col, island""")
def wb_many_lineage(spark, d):
    """The cells behind every monthly figure of all P2P tabs, as runs."""
    r = _reports(spark, d).lineage().where("tab = 'p2p'")
    ref = lambda at: F.concat("col", F.col(at).cast("string"))
    return r.select("workbook", "month_key", "metric_key", F.concat(ref("first"), F.lit(":"), ref("last")).alias("cells"), (F.col("last") - F.col("first") + 1).alias("n_cells"))


@query(f"""WITH {BASE_SQL},
u AS (
  SELECT k, topic, month_key, row, metric_key, value
  FROM p, LATERAL (VALUES ('gross_spend', gross_spend), ('immediate_raised', immediate_raised), ('donors', donors)) v(metric_key, value)
  WHERE k % 5 NOT IN (1, 3)),
w AS (
  SELECT k, month_key, 'all' AS slice_type, 'all' AS slice_value, metric_key, value FROM u
  UNION ALL SELECT k, month_key, 'audience', 'everyone', metric_key, value FROM u
  UNION ALL SELECT k, month_key, 'topic', topic, metric_key, value FROM u),
months AS (SELECT k, month_key, min(row) AS o FROM u GROUP BY ALL),
s AS (SELECT k, month_key, slice_type, slice_value, metric_key, sum(value) AS v FROM w GROUP BY ALL),
keys AS (SELECT DISTINCT k, slice_type, slice_value, metric_key FROM w)
SELECT 'part' || k || '.xlsx' AS workbook, slice_type, slice_value, metric_key, month_key, coalesce(v, 0) AS step,
       sum(coalesce(v, 0)) OVER (PARTITION BY k, slice_type, slice_value, metric_key ORDER BY o) AS running_total
FROM keys JOIN months USING (k) LEFT JOIN s USING (k, month_key, slice_type, slice_value, metric_key)""")
def wb_many_series(spark, d):
    return _reports(spark, d).series().select("workbook", "slice_type", "slice_value", "metric_key", "month_key", "step", "running_total")


@query(f"""WITH {BASE_SQL},
f AS (SELECT k, row, gross_spend / ntl AS want FROM p WHERE k % 5 NOT IN (1, 3) AND ntl <> 0 AND row % 4 = 0),
n AS (SELECT k, count(*) AS n FROM p WHERE k % 5 NOT IN (1, 3) AND ntl <> 0 GROUP BY k),
g AS (
  SELECT k, string_agg(printf('F%d shows %.2f, components give %.2f', row, floor(want * 100 + 0.5) / 100 + 1000000, floor(want * 100 + 0.5) / 100), '; ' ORDER BY row) FILTER (WHERE j <= 6) AS cells,
         count(*) AS bad
  FROM (SELECT *, row_number() OVER (PARTITION BY k ORDER BY row) AS j FROM f) GROUP BY k)
SELECT 'part' || k || '.xlsx' AS workbook, 'p2p' AS tab, 'RC9' AS rule_id,
       printf('Gross CPA is not spend ÷ NTL in %d of %d cells of P2P Statistics.', bad, n) AS text, cells,
       CAST(greatest(bad - 6, 0) AS INT) AS more_cells, 'p2-detail' AS sections
FROM g JOIN n USING (k)""")
def wb_many_flags(spark, d):
    """The whole flags: text, cells with both figures, how many more, and the sections that print them."""
    p = _reports(spark, d).problems.where("level = 'flag'")
    return p.select("workbook", "tab", "rule_id", "text", F.array_join("cells", "; ").alias("cells"), "more_cells", F.array_join("sections", ",").alias("sections"))


@query(f"""WITH {BASE_SQL}, b AS (SELECT k, sum(gross_spend) AS spend, k % 5 <> 3 AND k % 3 < 2 AS found FROM p WHERE k % 5 <> 1 GROUP BY k)
SELECT 'part' || k || '.xlsx' AS workbook, 199 + k % 3 AS head, CASE WHEN found THEN spend END AS gross_spend,
       CASE WHEN NOT found THEN 'No header row names “topic” and “audience”: the tab is not read.' END AS error
FROM b""")
def wb_many_anchor_depth(spark, d):
    """P2P tabs that begin far down: a header in row 199 or 200 is found, one in row 201 is not, and its tab is refused."""
    k = F.regexp_extract("workbook", r"[0-9]+", 0).cast("bigint")
    low = _cells(spark, d).where(F.col("sheet").endswith("P2P Statistics")).withColumn("row", (F.col("row") + 195 + k % 3).cast("int"))
    r = Reports(materialize(cells_of(to_files(low)), "cells"))
    spend = r.rollup().where("tab = 'p2p' AND level = 'total' AND metric_key = 'gross_spend'").select("workbook", F.col("value").alias("gross_spend"))
    wrong = r.problems.where("tab = 'p2p' AND level = 'error'").select("workbook", F.col("text").alias("error"))
    return spend.join(wrong, "workbook", "full_outer").select("workbook", (199 + k % 3).alias("head"), "gross_spend", "error")


@query(f"""WITH {BASE_SQL},
fix AS (
  SELECT k, 'digital' AS tab, 'error' AS level, 'RC13' AS rule_id,
         'The workbook has no “Digital Report”, only: ' || CASE k % 5 WHEN 1 THEN '' WHEN 2 THEN 'Our P2P Statistics, ' ELSE 'P2P Statistics, ' END || 'Paid Media Report.' AS text
  FROM books
  UNION ALL SELECT k, 'p2p', 'error', 'RC13', 'The workbook has no “P2P Statistics”, only: Paid Media Report.' FROM books WHERE k % 5 = 1
  UNION ALL SELECT k, 'p2p', 'warn', 'RC13', '“Our P2P Statistics” is read as “P2P Statistics”.' FROM books WHERE k % 5 = 2
  UNION ALL SELECT k, 'p2p', 'error', 'RC13', 'No header row names “topic” and “audience”: the tab is not read.' FROM books WHERE k % 5 = 3
  UNION ALL SELECT k, 'paid', 'warn', 'RC13',
    'Columns of the monthly table differ from the detail''s for Gross Spend, NTL; each table goes by its header.' FROM books WHERE k % 3 = 0
  UNION ALL SELECT k, 'paid', 'warn', 'RC13', 'Running totals take Gross Spend, NTL instead.' FROM books
  UNION ALL SELECT k, 'paid', 'error', 'RC5', printf('July, Gross Spend: the month has %.2f, its rows %.2f.', spend + 10, spend) FROM m WHERE k % 4 = 0 AND mi = 0
  UNION ALL SELECT k, 'paid', 'warn', 'RC6', 'October stands in the monthly table only.' FROM books
    WHERE k % 7 = 0 AND EXISTS (SELECT 1 FROM m WHERE m.k = books.k AND mi = 2)
  UNION ALL SELECT k, 'paid', 'warn', 'RC8', 'The quarterly table lacks Q3.' FROM books WHERE k % 6 = 0
  UNION ALL SELECT k, 'paid', 'error', 'RC7', printf('Gross Spend: Q3 has %.2f, its months %.2f.', sum(spend), sum(spend) + 10)
    FROM m WHERE k % 4 = 0 AND k % 6 <> 0 GROUP BY k HAVING count(*) FILTER (WHERE mi = 0) > 0)
SELECT 'part' || k || '.xlsx' AS workbook, tab, level, rule_id, text FROM fix
WHERE (SELECT count(*) FROM m WHERE m.k = fix.k) = 3""")
def wb_many_problems(spark, d):
    """What is wrong with each workbook that has all three months, in whole texts (of the tabs that some have)."""
    r = _reports(spark, d)
    full = r.rows.where("tab = 'paid' AND block = 'monthly'").groupBy("workbook").agg(F.count_if(F.element_at("t", "d:label").isin(*MONTHS)).alias("n")).where("n = 3").select("workbook")
    return r.problems.where("level <> 'flag' AND tab IN ('digital', 'paid', 'p2p')").join(full, "workbook").select("workbook", "tab", "level", "rule_id", "text")


@query(f"""WITH {BASE_SQL}, wrong AS (SELECT k FROM m WHERE k % 4 = 0 AND mi = 0)
SELECT workbook, 'p2p' AS tab FROM books WHERE k % 5 NOT IN (1, 3)
UNION ALL SELECT workbook, 'paid' FROM books WHERE k NOT IN (SELECT k FROM wrong) AND EXISTS (SELECT 1 FROM m WHERE m.k = books.k AND mi = 0)""")
def wb_many_published(spark, d):
    """Tabs without an error; a fault in one workbook hides nothing of another. Paid tabs that begin in July."""
    r = _reports(spark, d)
    july = r.rows.where("tab = 'paid' AND block = 'monthly'").where(F.element_at("t", "d:label") == MONTHS[0]).select("workbook").distinct()
    return r.published.where("tab = 'p2p'").unionByName(r.published.where("tab = 'paid'").join(july, "workbook").select("workbook", "tab"))


@query(f"""WITH {BASE_SQL}
SELECT 'part' || k || '.xlsx' AS workbook, count(*) * 5 AS n_values,
       CASE WHEN k % 10 = 0 THEN count(*) * 4 + count(*) FILTER (WHERE ntl <> 0) ELSE 0 END AS n_wrong
FROM p WHERE k % 5 NOT IN (1, 3) GROUP BY k""")
def wb_many_audit(spark, d):
    """Snapshots of all workbooks, published together, read again and held against the cells, of which a tenth of the workbooks have others since."""
    r = _reports(spark, d)
    folder = scratch_path(spark, "snapshots")
    docs = r.documents()
    publish(docs, folder)
    stored = spark.read.text(f"{folder}/*/*-data.json", wholetext=True).withColumnRenamed("value", "document")
    stored = stored.select("document", F.get_json_object("document", "$.meta.source_workbook").alias("workbook")).withColumn("path", F.col("workbook"))
    part = F.regexp_extract("workbook", "part([0-9]+)", 1).cast("int")
    cells = r.cells.where("kind <> 'sheet'").withColumn("num", F.when(part % 10 == 0, F.col("num") * 1.01 + 1).otherwise(F.col("num")))
    n = verify.claims(stored).groupBy(F.col("doc").alias("workbook")).agg(F.count(F.lit(1)).alias("n_values"))
    wrong = verify.audit(stored, cells).groupBy(F.col("doc").alias("workbook")).agg(F.count(F.lit(1)).alias("n_wrong"))
    return n.join(wrong, "workbook", "left").fillna(0, ["n_wrong"])


# Files by another hand than `workbook_bytes`: 50 customers each; every fourth has another fault.
FOREIGN_SQL = """f AS (
  SELECT *, CAST(c_custkey // 50 AS INT) AS file, CAST(row_number() OVER (PARTITION BY c_custkey // 50 ORDER BY c_custkey) AS INT) AS row FROM customer)"""


def _foreign(file: int, rows: list[tuple]) -> bytes:
    """Stored parts, no relations (or none that helps), inline, rich and formula strings, entities, ISO dates; a broken file for each residue but 0."""
    main = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"
    body, items = [], []
    for row, name, balance, segment in rows:
        seen = escape(f"{segment} & <{name}>").replace("U", "&#85;")
        items.append(f"<si><r><t>rich </t></r><r><rPr><b/></rPr><t>{seen}</t></r><rPh sb='0' eb='1'><t>never</t></rPh></si>")
        body.append(
            f'<row r="{row}"><c r="A{row}" t="inlineStr"><is><t>{seen}</t></is></c><c r="B{row}" t="str"><f>A{row}&amp;&quot;!&quot;</f><v>{escape(name)}!</v></c>'
            f'<c r="C{row}" t="s"><v>{row - 1}</v></c><c r="D{row}" t="d"><v>2026-08-03</v></c><c r="E{row}"><v>{balance!r}</v></c><c r="F{row}"/></row>'
        )
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_STORED) as z:
        if file % 4 != 1:
            z.writestr("xl/workbook.xml", f'<workbook xmlns="{main}"><sheets><sheet name="R&amp;D" sheetId="9"/></sheets></workbook>')
        z.writestr("xl/worksheets/sheet1.xml", f'<worksheet xmlns="{main}"><sheetData>{"".join(body)}</sheetData></worksheet>')
        z.writestr("xl/sharedStrings.xml", f'<sst xmlns="{main}">{"".join(items)}</sst>')
        if file % 4 == 2:
            z.writestr("EncryptedPackage", "x")
    data = out.getvalue()
    return b"a,b" + data if file % 4 == 3 else data


@query(f"""WITH {FOREIGN_SQL}, g AS (SELECT *, c_mktsegment || ' & <' || c_name || '>' AS seen FROM f WHERE file % 4 = 0)
SELECT 'f' || file AS workbook, 'R&D' AS sheet, col || row AS ref, kind, v_str, v_num, formula, NULL AS problem
FROM g, LATERAL (VALUES ('A', 'string', seen, NULL::DOUBLE, NULL), ('B', 'string', c_name || '!', NULL, '=A' || row || '&"!"'), ('C', 'string', 'rich ' || seen, NULL, NULL),
  ('D', 'number', NULL, 46237::DOUBLE, NULL), ('E', 'number', NULL, c_acctbal, NULL)) v(col, kind, v_str, v_num, formula)
UNION ALL SELECT 'f' || file, NULL, NULL, 'problem', NULL, NULL, NULL,
  CASE file % 4 WHEN 1 THEN 'This file has no workbook part.' WHEN 2 THEN 'This workbook is encrypted.' ELSE 'This is not an .xlsx file.' END
FROM (SELECT DISTINCT file FROM f WHERE file % 4 <> 0)""")
def wb_foreign_cells(spark, d):
    """Files that our own writer does not make, and files that are refused, each with its reason."""
    c = F.col
    own = table(spark, d, "customer").withColumn("file", F.expr("c_custkey div 50"))
    own = own.withColumn("row", F.row_number().over(W.partitionBy("file").orderBy("c_custkey"))).select("file", "row", "c_name", "c_acctbal", "c_mktsegment")

    def make(frame: pd.DataFrame) -> pd.DataFrame:
        file = int(frame["file"].iloc[0])
        rows = frame.sort_values("row")[["row", "c_name", "c_acctbal", "c_mktsegment"]]
        return pd.DataFrame({"path": [f"f{file}"], "content": [_foreign(file, list(rows.itertuples(index=False, name=None)))]})

    files = own.groupBy("file").applyInPandas(make, "path string, content binary")
    cells = cells_or_problems(files)
    none = F.lit(None).cast("string")
    return cells.where("kind <> 'sheet'").select("workbook", c("sheet"), F.when(c("kind") != "problem", c("ref")).otherwise(none).alias("ref"), "kind", "v_str", "v_num", "formula", "problem")
