"""The registered report queries over the Parquet tables, and the same queries as SQL.

Stand-ins: `lineitem` is the paid-media detail (month of shipping; spend = price x discount, NTL = quantity, raised = price), `orders` with
`customer` the topic and audience detail, `events` the donations by category.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import semantics as S
from ..operators.ordinal import ordinals
from ..operators import compare, lineage, reconcile, rollup, series
from ..operators.catalog import Catalog, Metric

PAID = Catalog(
    [
        Metric("spend", "Gross Spend", "usd"),
        Metric("ntl", "NTL", "count"),
        Metric("raised", "Total Raised", "usd"),
        Metric("cpa", "Gross CPA", "usd2", None, "spend", "ntl"),
        Metric("roas", "Total ROAS", "roas", None, "raised", "spend"),
        Metric("click_rate", "Click Rate", "rate"),
    ]
)
RAISED = Catalog([Metric("raised", "Raised", "usd")])
AMOUNT = Catalog([Metric("amount", "Amount", "usd")])

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def paid_detail(spark: SparkSession, d: str) -> DataFrame:
    li = table(spark, d, "lineitem")
    # cents, rounded half up, in exact decimals
    spend = (F.col("l_extendedprice").cast("decimal(18,2)") * F.col("l_discount").cast("decimal(4,2)")).cast("decimal(18,2)")
    return li.select(
        F.date_format("l_shipdate", "yyyy-MM").alias("month"),
        F.year("l_shipdate").alias("year"),
        F.quarter("l_shipdate").alias("quarter"),
        F.col("l_returnflag").alias("channel"),
        F.col("l_linestatus").alias("placement"),
        spend.alias("spend"),
        F.col("l_quantity").alias("ntl"),
        F.col("l_extendedprice").alias("raised"),
    )


# Fixed text for the SQL side: the same detail.
PAID_SQL = """paid AS (SELECT strftime(l_shipdate, '%Y-%m') AS month, CAST(year(l_shipdate) AS INT) AS year, CAST(quarter(l_shipdate) AS INT) AS quarter,
 l_returnflag AS channel, l_linestatus AS placement,
 CAST(CAST(l_extendedprice AS DECIMAL(18,2)) * CAST(l_discount AS DECIMAL(4,2)) AS DECIMAL(18,2)) AS spend, CAST(l_quantity AS DECIMAL(18,2)) AS ntl,
 CAST(l_extendedprice AS DECIMAL(18,2)) AS raised FROM lineitem)"""
PAID_SUMS = "CAST(sum(spend) AS DOUBLE) AS spend, CAST(sum(ntl) AS DOUBLE) AS ntl, CAST(sum(raised) AS DOUBLE) AS raised"
PAID_RATIOS = "CASE WHEN coalesce(ntl,0)<>0 THEN coalesce(spend,0)/ntl END AS cpa, CASE WHEN coalesce(spend,0)<>0 THEN coalesce(raised,0)/spend END AS roas"


def topic_detail(spark: SparkSession, d: str) -> DataFrame:
    o, c = table(spark, d, "orders"), table(spark, d, "customer")
    rows = o.select("o_orderkey", "o_custkey", F.date_format("o_orderdate", "yyyy-MM").alias("month"), F.col("o_orderpriority").alias("topic"), F.col("o_totalprice").alias("raised"))
    # customers grow with orders, so that neither side is sent whole to the driver and all executors
    return rows.join(c.select("c_custkey", F.col("c_mktsegment").alias("audience")).hint("merge"), F.col("o_custkey") == F.col("c_custkey"))


TOPIC_SQL = """t AS (SELECT o_orderkey, strftime(o_orderdate, '%Y-%m') AS month, o_orderpriority AS topic, CAST(o_totalprice AS DECIMAL(18,2)) AS raised,
 c_mktsegment AS audience FROM orders JOIN customer ON o_custkey = c_custkey)"""


@query(f"WITH {PAID_SQL}, s AS (SELECT month, {PAID_SUMS}, count(*) AS row_count FROM paid GROUP BY month) SELECT *, {PAID_RATIOS}, CAST(NULL AS DOUBLE) AS click_rate FROM s")
def rollup_month_ratios(spark, d):
    return rollup.rollup(paid_detail(spark, d), ["month"], PAID)


@query(
    f"WITH {PAID_SQL}, s AS (SELECT year, quarter, {PAID_SUMS}, count(*) AS row_count FROM paid GROUP BY year, quarter) "
    f"SELECT year, quarter, 'Q' || quarter AS label, spend, ntl, raised, row_count, {PAID_RATIOS} FROM s"
)
def rollup_quarter_to_date(spark, d):
    r = rollup.rollup(paid_detail(spark, d), ["year", "quarter"], PAID).drop("click_rate")
    return r.withColumn("label", S.quarter_label("quarter"))


@query(f"""WITH {TOPIC_SQL} SELECT month, audience, topic, CAST(grouping(month, audience, topic) AS INT) AS level, CAST(sum(raised) AS DOUBLE) AS raised, count(*) AS row_count
 FROM t GROUP BY GROUPING SETS ((month), (month, audience), (month, topic), ())""")
def rollup_grouping_sets(spark, d):
    return rollup.rollup_sets(topic_detail(spark, d), [["month"], ["month", "audience"], ["month", "topic"], []], RAISED)


@query(f"WITH {PAID_SQL}, s AS (SELECT {', '.join(f'coalesce(CAST(sum({k}) AS DOUBLE), 0) AS {k}' for k in ('spend', 'ntl', 'raised'))} FROM paid WHERE year = 1996) SELECT *, {PAID_RATIOS} FROM s")
def ytd_additive_and_ratio(spark, d):
    return rollup.year_to_date(paid_detail(spark, d).where("year = 1996"), PAID).drop("row_count", "click_rate")


@query(f"""WITH {PAID_SQL} SELECT month, channel, placement, CAST(spend AS DOUBLE) AS spend, CAST(raised AS DOUBLE) AS raised,
 CASE WHEN spend <> 0 THEN CAST(raised AS DOUBLE) / CAST(spend AS DOUBLE) END AS roas FROM paid WHERE coalesce(spend, 0) = 0""")
def ratio_zero_denominator(spark, d):
    p = paid_detail(spark, d).where(~S.truthy("spend"))
    p = p.select("month", "channel", "placement", F.col("spend").cast("double").alias("spend"), "raised")
    return p.withColumn("roas", S.ratio("raised", "spend"))


@query(f"""WITH {PAID_SQL}, r AS (SELECT channel, CAST(raised AS DOUBLE) / CAST(spend AS DOUBLE) AS one, spend, raised FROM paid WHERE spend <> 0)
 SELECT channel, abs(avg(one) - CAST(sum(raised) AS DOUBLE) / CAST(sum(spend) AS DOUBLE)) > 0.01 AS differs, count(*) AS n FROM r GROUP BY channel""")
def ratio_vs_naive_average(spark, d):
    p = paid_detail(spark, d).where(S.truthy("spend")).withColumn("one", S.ratio("raised", F.col("spend").cast("double")))
    naive = rollup.naive_average(p, ["channel"], "one")
    right = rollup.rollup(p, ["channel"], PAID)
    return right.join(naive, "channel").select("channel", (F.abs(F.col("naive") - F.col("roas")) > 0.01).alias("differs"), F.col("row_count").alias("n"))


@query("SELECT event_type AS category, CAST(sum(CAST(value AS DECIMAL(18,2))) AS DOUBLE) AS amount, count(*) AS row_count FROM events GROUP BY 1")
def rollup_count_amount(spark, d):
    e = table(spark, d, "events").select(F.col("event_type").alias("category"), F.col("value").alias("amount"))
    return rollup.rollup(e, ["category"], AMOUNT)


def _status_cells(spark, d) -> DataFrame:
    """Orders as cells of one column, by status."""
    o = table(spark, d, "orders")
    return o.select(F.col("o_orderstatus").alias("status"), F.date_format("o_orderdate", "yyyy-MM").alias("month"), F.lit("raised").alias("metric_key"), S.money("o_totalprice").alias("value"), F.concat(F.lit("T"), F.col("o_orderkey").cast("string")).alias("cell"))


@query("SELECT strftime(o_orderdate, '%Y-%m') AS month, CAST(count(*) AS INT) AS n_cells, count(DISTINCT o_orderkey) AS n_rows FROM orders GROUP BY 1")
def rollup_lineage_count(spark, d):
    r = rollup.long_rollup(_status_cells(spark, d), ["month"], with_lineage=True)
    return r.select("month", lineage.n_cells("runs").cast("int").alias("n_cells"), F.col("row_count").alias("n_rows"))


@query("""WITH i AS (SELECT o_orderstatus AS status, o_orderkey AS k, o_orderkey - row_number() OVER (PARTITION BY o_orderstatus ORDER BY o_orderkey) AS island FROM orders)
 SELECT status, 'T' || min(k) || ':T' || max(k) AS cells, count(*) AS n_cells FROM i GROUP BY status, island""")
def lineage_runs(spark, d):
    """The orders of each status as runs of adjacent keys; a status of a third of all rows is found in chunks."""
    r = lineage.runs(_status_cells(spark, d), ["status"])
    at = lambda c: F.concat("col", F.col(c).cast("string"))
    return r.select("status", F.concat(at("first"), F.lit(":"), at("last")).alias("cells"), (F.col("last") - F.col("first") + 1).alias("n_cells"))


def _goal_actual(spark, d) -> DataFrame:
    """Orders by status and month: goal is what was ordered, actual what was shipped in lines of that month, often missing."""
    o, li = table(spark, d, "orders"), table(spark, d, "lineitem")
    goal = o.groupBy(F.col("o_orderstatus").alias("channel"), F.date_format("o_orderdate", "yyyy-MM").alias("month")).agg(S.exact_sum("o_totalprice").alias("goal"))
    kept = li.where("l_quantity >= 50 AND l_discount = 0 AND l_linenumber = 1").select("l_orderkey", "l_extendedprice")
    actual = kept.join(o.select("o_orderkey", F.col("o_orderstatus").alias("channel"), F.date_format("o_orderdate", "yyyy-MM").alias("month")), F.col("l_orderkey") == F.col("o_orderkey"))
    actual = actual.groupBy("channel", "month").agg(S.exact_sum("l_extendedprice").alias("actual"))
    return goal.join(actual, ["channel", "month"], "left")


GOAL_SQL = """ga AS (SELECT * FROM (SELECT o_orderstatus AS channel, strftime(o_orderdate, '%Y-%m') AS month, sum(CAST(o_totalprice AS DECIMAL(18,2))) AS goal FROM orders GROUP BY 1, 2)
 LEFT JOIN (SELECT o_orderstatus AS channel, strftime(o_orderdate, '%Y-%m') AS month, sum(CAST(l_extendedprice AS DECIMAL(18,2))) AS actual FROM lineitem JOIN orders ON l_orderkey = o_orderkey
 WHERE l_quantity >= 50 AND l_discount = 0 AND l_linenumber = 1 GROUP BY 1, 2) USING (channel, month))"""
_W = "OVER (PARTITION BY channel ORDER BY month ROWS UNBOUNDED PRECEDING)"


def _running(policy):
    def run(spark, d):
        rows = _goal_actual(spark, d).withColumn("actual", S.money("actual"))
        r = series.series(rows, "actual", ["channel"], "month", policy)
        return r.select("channel", "month", F.col("step").cast("double").alias("step"), F.col("running_total").cast("double").alias("running_total"), "pending")

    return run


for _policy, _step, _total, _pending in (
    ("pending", "actual", f"CASE WHEN actual IS NULL THEN NULL ELSE sum(coalesce(actual,0)) {_W} END", "actual IS NULL"),
    ("carry", "actual", f"sum(coalesce(actual,0)) {_W}", "false"),
    ("zero", "coalesce(actual, 0)", f"sum(coalesce(actual,0)) {_W}", "false"),
):
    QUERIES[f"running_total_{_policy}"] = _running(_policy)
    SQL[f"running_total_{_policy}"] = f"WITH {GOAL_SQL} SELECT channel, month, CAST({_step} AS DOUBLE) AS step, CAST({_total} AS DOUBLE) AS running_total, {_pending} AS pending FROM ga"


def _dense(spark, d, slice_: str) -> DataFrame:
    t = topic_detail(spark, d)
    sums = t.groupBy("month", slice_).agg(F.sum(S.money("raised")).alias("v"))
    grid = series.dense(sums, sums.select("month").distinct(), sums.select(slice_).distinct(), ["month", slice_])
    r = series.series(grid, "v", [slice_], "month", "zero")
    return r.select(slice_, "month", F.col("step").cast("double").alias("step"), F.col("running_total").cast("double").alias("running_total"))


def _dense_sql(slice_: str) -> str:
    return f"""WITH {TOPIC_SQL}, s AS (SELECT month, {slice_}, sum(raised) AS v FROM t GROUP BY 1, 2),
 g AS (SELECT * FROM (SELECT DISTINCT month FROM s) CROSS JOIN (SELECT DISTINCT {slice_} FROM s) LEFT JOIN s USING (month, {slice_}))
 SELECT {slice_}, month, CAST(coalesce(v, 0) AS DOUBLE) AS step, CAST(sum(coalesce(v, 0)) OVER (PARTITION BY {slice_} ORDER BY month ROWS UNBOUNDED PRECEDING) AS DOUBLE) AS running_total FROM g"""


@query(_dense_sql("audience"))
def series_dense_by_audience(spark, d):
    return _dense(spark, d, "audience")


@query(_dense_sql("topic"))
def series_dense_by_topic(spark, d):
    return _dense(spark, d, "topic")


@query("""WITH s AS (SELECT CAST(ts AS DATE) AS day, event_type AS category, sum(CAST(value AS DECIMAL(18,2))) AS v FROM events GROUP BY 1, 2),
 g AS (SELECT * FROM (SELECT DISTINCT day FROM s) CROSS JOIN (SELECT DISTINCT category FROM s) LEFT JOIN s USING (day, category))
 SELECT category, day, CAST(sum(coalesce(v, 0)) OVER (PARTITION BY category ORDER BY day ROWS UNBOUNDED PRECEDING) AS DOUBLE) AS running_total FROM g""")
def series_by_category(spark, d):
    e = table(spark, d, "events").select(F.to_date("ts").alias("day"), F.col("event_type").alias("category"), S.money("value").alias("value"))
    sums = e.groupBy("day", "category").agg(F.sum("value").alias("v"))
    grid = series.dense(sums, sums.select("day").distinct(), sums.select("category").distinct(), ["day", "category"])
    r = series.series(grid, "v", ["category"], "day", "zero")
    return r.select("category", "day", F.col("running_total").cast("double").alias("running_total"))


@query(f"""WITH {GOAL_SQL}, c AS (SELECT channel, month, goal, actual, CAST(sum(coalesce(goal,0)) {_W} AS DOUBLE) AS cum_goal, CAST(CASE WHEN actual IS NOT NULL THEN sum(coalesce(actual,0)) {_W} END AS DOUBLE) AS cum_actual FROM ga)
 SELECT channel, month, cum_goal, cum_actual, CASE WHEN cum_actual IS NOT NULL AND cum_goal <> 0 THEN cum_actual / cum_goal END AS pace, CAST(actual AS DOUBLE) - CAST(goal AS DOUBLE) AS gap,
 CASE WHEN goal <> 0 AND actual IS NOT NULL THEN least(100.0, CAST(actual AS DOUBLE) / CAST(goal AS DOUBLE) * 100) END AS fill_percent FROM c""")
def running_total_goal_pace(spark, d):
    rows = _goal_actual(spark, d)
    for c, policy in (("goal", "carry"), ("actual", "pending")):
        rows = rows.withColumn("m", S.money(c)).withColumn(f"cum_{c}", series.running("m", ["channel"], "month", policy).cast("double"))
    fill = F.when(F.col("actual").isNotNull() & S.truthy("goal"), F.least(F.lit(100.0), F.col("actual") / F.col("goal") * 100))
    return rows.select("channel", "month", "cum_goal", "cum_actual", F.try_divide("cum_actual", "cum_goal").alias("pace"), (F.col("actual") - F.col("goal")).alias("gap"), fill.alias("fill_percent"))


@query(f"WITH {GOAL_SQL} SELECT month FROM ga GROUP BY month HAVING bool_and(actual IS NULL)")
def pending_months(spark, d):
    return series.pending_periods(_goal_actual(spark, d), "month", "actual")


@query("""SELECT c_custkey AS channel, CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) AS goal, coalesce(sum(CAST(o_totalprice AS DECIMAL(18,2))), 0) = 0 AS dormant
 FROM customer LEFT JOIN orders ON c_custkey = o_custkey AND o_orderstatus = 'P' GROUP BY 1""")
def dormant_channels(spark, d):
    c, o = table(spark, d, "customer"), table(spark, d, "orders").where("o_orderstatus = 'P'")
    j = c.select(F.col("c_custkey").alias("channel")).join(o.select("o_custkey", "o_totalprice"), F.col("channel") == F.col("o_custkey"), "left")
    r = j.groupBy("channel").agg(S.exact_sum("o_totalprice").alias("goal")).withColumn("none", F.lit(None).cast("double"))
    return r.select("channel", "goal", series.dormant("goal", "none").alias("dormant"))


@query("SELECT strftime(o_orderdate, '%Y-%m') AS month_key, min(o_orderkey) AS first_row, arg_min(strftime(o_orderdate, '%B %Y'), o_orderkey) AS label, CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) AS raised, count(*) AS row_count FROM orders GROUP BY 1")
def first_appearance_months(spark, d):
    o = table(spark, d, "orders").select(F.date_format("o_orderdate", "yyyy-MM").alias("month_key"), S.month_label("o_orderdate").alias("month"), F.col("o_orderkey").alias("row"), F.col("o_totalprice").alias("raised"))
    return rollup.monthly(o, RAISED)


@query("SELECT DISTINCT p_brand AS category FROM part WHERE p_brand <> '' UNION SELECT DISTINCT event_type FROM events WHERE event_type <> ''")
def distinct_sorted_categories(spark, d):
    a, b = table(spark, d, "part").select(F.col("p_brand").alias("category")), table(spark, d, "events").select(F.col("event_type").alias("category"))
    return a.unionByName(b).where("category <> ''").distinct().orderBy(F.collate("category", "UNICODE"))


@query("SELECT DISTINCT o_orderpriority AS label, regexp_replace(regexp_replace(lower(trim(o_orderpriority)), '[^a-z0-9]+', '_', 'g'), '^_|_$', '', 'g') AS slug FROM orders")
def header_slug(spark, d):
    o = table(spark, d, "orders").select(F.col("o_orderpriority").alias("label")).distinct()
    return o.withColumn("slug", S.slug("label"))


@query("SELECT DISTINCT p_type AS label, regexp_replace(lower(trim(regexp_replace('  ' || p_type || ' :', '\\s+', ' ', 'g'))), ':$', '') AS norm FROM part")
def header_norm(spark, d):
    p = table(spark, d, "part").select(F.col("p_type").alias("label")).distinct()
    return p.withColumn("norm", S.norm(F.concat(F.lit("  "), "label", F.lit(" :"))))


_LABELS = "unnest(['ROAS','Total ROAS','Donate Rate','Rates','Gross CPA','Cost per name','Average Gift','NTL','Names','Account','Recipients','Donors','Unsub','Unsubs','Action','Actions taken','Gross Spend'])"


@query(f"""WITH l AS (SELECT p_type || ' ' || label AS label FROM (SELECT DISTINCT p_type FROM part), (SELECT {_LABELS} AS label) UNION SELECT label FROM (SELECT {_LABELS} AS label)), n AS (SELECT label, lower(trim(label)) AS k FROM l)
 SELECT label, CASE WHEN regexp_matches(k, 'roas') THEN 'roas' WHEN regexp_matches(k, 'rate$') THEN 'rate' WHEN regexp_matches(k, 'cpa|cost per|average') THEN 'usd2'
 WHEN regexp_matches(k, '^ntl$|names|count|recipients|donors|unsubs?$|actions?$') THEN 'count' ELSE 'usd' END AS kind FROM n""")
def metric_kind_classify(spark, d):
    words = ["ROAS", "Total ROAS", "Donate Rate", "Rates", "Gross CPA", "Cost per name", "Average Gift", "NTL", "Names", "Account", "Recipients", "Donors", "Unsub", "Unsubs", "Action", "Actions taken", "Gross Spend"]
    alone = spark.createDataFrame([(w,) for w in words], "label string")
    types = table(spark, d, "part").select("p_type").distinct()
    both = types.withColumn("w", F.explode(F.array(*[F.lit(w) for w in words]))).select(F.concat_ws(" ", "p_type", "w").alias("label"))
    return both.unionByName(alone).distinct().withColumn("kind", S.metric_kind("label"))


@query("SELECT o_orderkey, CAST(o_orderdate AS DATE) AS day, CAST(CAST(o_orderdate AS DATE) - DATE '1899-12-30' AS DOUBLE) AS serial, CAST(o_orderdate AS DATE) AS back FROM orders")
def excel_serial_roundtrip(spark, d):
    o = table(spark, d, "orders").select("o_orderkey", F.to_date("o_orderdate").alias("day"))
    return o.withColumn("serial", S.date_serial("day")).withColumn("back", S.serial_date("serial"))


@query("SELECT o_orderkey, strftime(o_orderdate, '%B %Y') AS month, 'Q' || quarter(o_orderdate) AS quarter, CAST(year(o_orderdate) AS INT) AS year FROM orders")
def period_labels(spark, d):
    return table(spark, d, "orders").select("o_orderkey", S.month_label("o_orderdate").alias("month"), S.quarter_label(F.quarter("o_orderdate")).alias("quarter"), F.year("o_orderdate").alias("year"))


@query("""WITH n AS (SELECT DISTINCT CAST((p_partkey - 1) % 18278 + 1 AS INT) AS n FROM part WHERE p_partkey > 0)
 SELECT n, (CASE WHEN n > 702 THEN chr(CAST(65 + (n - 703) // 676 % 26 AS INT)) ELSE '' END) || (CASE WHEN n > 26 THEN chr(CAST(65 + (n - 27) // 26 % 26 AS INT)) ELSE '' END) || chr(CAST(65 + (n - 1) % 26 AS INT)) AS letters, n AS back, CAST(7 AS INT) AS row FROM n""")
def cell_ref_encode_decode(spark, d):
    n = table(spark, d, "part").where("p_partkey > 0").select(((F.col("p_partkey") - 1) % 18278 + 1).cast("int").alias("n")).distinct()
    n = n.withColumn("letters", S.column_letters("n")).withColumn("ref", F.concat("letters", F.lit("7")))
    return n.select("n", "letters", S.column_number(S.cell_column("ref")).alias("back"), S.cell_row("ref").alias("row"))


@query("""SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, l_extendedprice AS price, CASE WHEN l_quantity % 7 = 0 THEN NULL ELSE CAST(CAST(round(l_discount * 100) AS INT) AS DOUBLE) END AS percent, l_quantity AS prefix FROM lineitem""")
def lenient_number_parse(spark, d):
    li = table(spark, d, "lineitem")
    shown = F.concat(F.lit(" $"), F.format_number("l_extendedprice", 2))
    percent = F.when(F.col("l_quantity") % 7 == 0, "-").otherwise(F.concat(F.round(F.col("l_discount") * 100).cast("int").cast("string"), F.lit("%")))
    prefix = F.concat(S.number_text("l_quantity"), F.lit("abc"))
    return li.select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", S.lenient_number(shown).alias("price"), S.lenient_number(percent).alias("percent"), S.lenient_number(prefix).alias("prefix"))


@query("""SELECT * FROM (VALUES ('c_name', false), ('c_acctbal', true), ('c_mktsegment', false), ('c_custkey', true)) v(col, is_numeric)""")
def numeric_column_test(spark, d):
    c = table(spark, d, "customer").select(*[F.col(x).cast("string").alias(x) for x in ("c_name", "c_acctbal", "c_mktsegment", "c_custkey")])
    long = c.unpivot([], list(c.columns), "col", "text")
    return long.where("text IS NOT NULL").groupBy("col").agg(F.bool_and(S.lenient_number("text").isNotNull()).alias("is_numeric"))


@query("""WITH t AS (SELECT conv_id, turn, coalesce(lead(turn) OVER (PARTITION BY conv_id ORDER BY turn), -1) AS nxt FROM (SELECT DISTINCT conv_id, turn FROM conversations))
 SELECT conv_id, min(turn) AS first_row, min(turn) FILTER (WHERE nxt <> turn + 1) + 1 AS stop_row FROM t GROUP BY conv_id""")
def block_stop_row(spark, d):
    t = table(spark, d, "conversations").select("conv_id", "turn").distinct()
    following = F.lead("turn").over(W.partitionBy("conv_id").orderBy("turn"))
    t = t.withColumn("last", ~F.coalesce(following == F.col("turn") + 1, F.lit(False)))
    return t.groupBy("conv_id").agg(F.min("turn").alias("first_row"), (F.min(F.when(F.col("last"), F.col("turn"))) + 1).alias("stop_row"))


@query(f"""WITH {PAID_SQL}, u AS (UNPIVOT (SELECT channel, month, spend, ntl, raised FROM paid) ON spend, ntl, raised INTO NAME metric_key VALUE value)
 SELECT channel, month, metric_key, CAST(sum(value) AS DOUBLE) AS value, count(*) AS row_count FROM u GROUP BY ALL""")
def metrics_unpivot_long(spark, d):
    p = paid_detail(spark, d).select("channel", "month", *[S.money(k).alias(k) for k in ("spend", "ntl", "raised")])
    long = p.unpivot(["channel", "month"], ["spend", "ntl", "raised"], "metric_key", "value")
    return rollup.long_rollup(long, ["channel", "month"]).withColumn("value", F.col("value").cast("double"))


@query("""SELECT source, CASE WHEN contains(source, 'src1') THEN 'import one' WHEN contains(source, 'src2') THEN 'import two' ELSE 'other' END AS origin, count(*) AS n FROM documents GROUP BY ALL""")
def source_attribution(spark, d):
    origin = F.when(F.contains(F.col("source"), F.lit("src1")), "import one").when(F.contains(F.col("source"), F.lit("src2")), "import two").otherwise("other")
    return table(spark, d, "documents").groupBy("source", origin.alias("origin")).agg(F.count(F.lit(1)).alias("n"))


CHILDREN_SQL = """j AS (SELECT o_orderkey, o_totalprice, s.child_sum, s.n IS NULL AS missing, s.n IS NOT NULL AND NOT coalesce(abs(o_totalprice - s.child_sum) <= 0.05, false) AS bad
 FROM orders LEFT JOIN (SELECT l_orderkey, CAST(sum(CAST(l_extendedprice AS DECIMAL(18,2))) AS DOUBLE) AS child_sum, count(*) AS n FROM lineitem GROUP BY 1) s ON o_orderkey = l_orderkey)"""


def _children(spark, d) -> DataFrame:
    li = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), "l_extendedprice")
    o = table(spark, d, "orders").select("o_orderkey", "o_totalprice")
    return reconcile.children_vs_total(li, o, "o_orderkey", "l_extendedprice", "o_totalprice")


@query(f"WITH {CHILDREN_SQL} SELECT o_orderkey, o_totalprice, child_sum, bad FROM j WHERE bad")
def reconcile_children_vs_total(spark, d):
    return _children(spark, d).where("bad").select("o_orderkey", "o_totalprice", "child_sum", "bad")


@query(f"WITH {CHILDREN_SQL} SELECT o_orderkey FROM j WHERE missing")
def reconcile_missing_children(spark, d):
    return _children(spark, d).where("missing").select("o_orderkey")


@query("SELECT count(*) AS n_checked, CAST(count_if(n_chars <> length(text)) AS BIGINT) AS n_bad FROM documents")
def reconcile_stored_column(spark, d):
    t = table(spark, d, "documents").select("n_chars", F.length("text").alias("want"))
    return t.agg(F.count(F.lit(1)).alias("n_checked"), F.count_if(F.col("n_chars") != F.col("want")).alias("n_bad"))


_CPA = reconcile.Identity("RC3", "stored", "spend", "ntl", "Gross CPA", "spend / NTL")
IDENTITY_SQL = """p AS (SELECT o_orderkey AS row, o_orderpriority AS topic, o_totalprice AS spend, CAST(o_custkey AS DOUBLE) AS ntl, o_totalprice / o_custkey + CASE WHEN o_orderkey % 97 = 0 THEN 1 ELSE 0 END AS stored FROM orders),
 b AS (SELECT *, NOT coalesce(abs(stored - spend / ntl) <= greatest(0.02, abs(spend / ntl) * 1e-6), false) AS bad FROM p WHERE ntl <> 0)"""


def _identity_rows(spark, d) -> DataFrame:
    o = table(spark, d, "orders")
    wrong = F.when(F.col("o_orderkey") % 97 == 0, 1).otherwise(0)
    ntl = F.col("o_custkey").cast("double")
    return o.select(F.col("o_orderkey").alias("row"), F.col("o_orderpriority").alias("topic"), F.col("o_totalprice").alias("spend"), ntl.alias("ntl"), (F.col("o_totalprice") / ntl + wrong).alias("stored"), F.concat(F.lit("K"), F.col("o_orderkey").cast("string")).alias("cell"))


@query(f"WITH {IDENTITY_SQL} SELECT topic, count(*) AS n_checked, CAST(count_if(bad) AS BIGINT) AS n_bad, CAST(greatest(0, count_if(bad) - 6) AS INT) AS more_cells FROM b GROUP BY topic")
def reconcile_ratio_identity(spark, d):
    return reconcile.identity(_identity_rows(spark, d), _CPA, ["topic"], ["row"], "cell").drop("cells")


@query(f"""WITH {IDENTITY_SQL}, r AS (SELECT *, row_number() OVER (PARTITION BY topic ORDER BY row) AS k FROM b WHERE bad)
 SELECT topic, string_agg('K' || row, ',' ORDER BY row) FILTER (WHERE k <= 6) AS cells, CAST(greatest(0, count(*) - 6) AS INT) AS more_cells FROM r GROUP BY topic""")
def flag_top6_and_remainder(spark, d):
    bad = reconcile.checked(_identity_rows(spark, d), _CPA).where("bad")
    n = bad.groupBy("topic").agg(F.greatest(F.lit(0), F.count(F.lit(1)) - S.MAX_CELLS).cast("int").alias("more_cells"))
    return n.join(reconcile.first_of(bad, ["topic"], ["row"], "cell", "cells"), "topic").withColumn("cells", F.array_join("cells", ","))


@query(f"""WITH {CHILDREN_SQL}, {IDENTITY_SQL}, x AS (SELECT 'orders' AS tab, 'error' AS level FROM j WHERE bad UNION ALL SELECT 'orders', 'warn' FROM j WHERE missing UNION ALL SELECT topic, 'flag' FROM b WHERE bad)
 SELECT tab, CAST(count_if(level = 'error') AS BIGINT) AS n_error, CAST(count_if(level = 'warn') AS BIGINT) AS n_warn, CAST(count_if(level = 'flag') AS BIGINT) AS n_flag, count(*) AS n_problems FROM x GROUP BY tab""")
def problem_counts(spark, d):
    j = _children(spark, d)
    level = F.when(F.col("bad"), "error").when(F.col("missing"), "warn")
    a = j.select(F.lit("orders").alias("tab"), level.alias("level")).where("level IS NOT NULL")
    b = reconcile.checked(_identity_rows(spark, d), _CPA).where("bad").select(F.col("topic").alias("tab"), F.lit("flag").alias("level"))
    return reconcile.problems_by_level(a.unionByName(b))


_FILTER = "channel = 'R' AND month LIKE '1995%'"


@query(f"WITH {PAID_SQL}, s AS (SELECT channel, placement, month, {PAID_SUMS}, count(*) AS row_count FROM paid WHERE {_FILTER} GROUP BY 1, 2, 3) SELECT *, {PAID_RATIOS} FROM s")
def leaderboard_filtered(spark, d):
    from ..operators.views import filtered, leaderboard

    p = filtered(paid_detail(spark, d), channel="R").where("month LIKE '1995%'")
    return leaderboard(p, ["channel", "placement", "month"], PAID, "raised").drop("click_rate")


@query(f"WITH {PAID_SQL}, s AS (SELECT channel, placement, CAST(grouping(channel, placement) AS INT) AS level, {PAID_SUMS}, count(*) AS row_count FROM paid WHERE {_FILTER} GROUP BY GROUPING SETS ((channel, placement), ())) SELECT *, {PAID_RATIOS} FROM s")
def leaderboard_totals(spark, d):
    p = paid_detail(spark, d).where(_FILTER)
    return rollup.rollup_sets(p, [["channel", "placement"], []], PAID).drop("click_rate")


@query("""WITH s AS (SELECT c_mktsegment AS channel, CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) AS goal, CAST(sum(CASE WHEN o_orderstatus = 'F' AND c_mktsegment <> 'BUILDING' THEN CAST(o_totalprice AS DECIMAL(18,2)) END) AS DOUBLE) AS actual
 FROM customer JOIN orders ON c_custkey = o_custkey GROUP BY 1) SELECT channel, goal, actual, CASE WHEN goal <> 0 THEN coalesce(actual, 0) / goal END AS pct, CAST(row_number() OVER (ORDER BY CASE WHEN goal = 0 THEN -1 ELSE coalesce(coalesce(actual, 0) / goal, 0) END DESC, channel) AS INT) AS place FROM s""")
def channel_sort_dormant_last(spark, d):
    from ..operators.views import channel_order

    c, o = table(spark, d, "customer"), table(spark, d, "orders")
    j = o.join(c, F.col("o_custkey") == F.col("c_custkey"))
    actual = F.when((F.col("o_orderstatus") == "F") & (F.col("c_mktsegment") != "BUILDING"), S.money("o_totalprice"))
    s = j.groupBy(F.col("c_mktsegment").alias("channel")).agg(S.exact_sum("o_totalprice").alias("goal"), F.sum(actual).cast("double").alias("actual"))
    s = s.withColumn("pct", S.ratio("actual", "goal")).withColumn("dormant", series.dormant("goal", "actual"))
    return channel_order(s, "pct", "dormant", "channel").select("channel", "goal", "actual", "pct", "place")


@query(f"""WITH {PAID_SQL} SELECT month, {', '.join(f"CAST(sum(raised) FILTER (WHERE channel = '{c}') AS DOUBLE) AS {c.lower()}" for c in 'ANR')} FROM paid GROUP BY month""")
def stack_month_by_channel(spark, d):
    from ..operators.views import stack

    return stack(paid_detail(spark, d), "month", "channel", ["A", "N", "R"], "raised").withColumnsRenamed({"A": "a", "N": "n", "R": "r"})


@query(f"WITH {PAID_SQL}, s AS (SELECT channel, placement, month, {PAID_SUMS} FROM paid GROUP BY 1, 2, 3), r AS (SELECT *, {PAID_RATIOS} FROM s) SELECT channel, placement, month, cpa, roas FROM r WHERE cpa > 0 AND roas IS NOT NULL")
def scatter_eligible(spark, d):
    from ..operators.views import scatter

    r = rollup.rollup(paid_detail(spark, d), ["channel", "placement", "month"], PAID)
    return scatter(r, "cpa", "roas").select("channel", "placement", "month", "cpa", "roas")


@query("""WITH q AS (SELECT 'events' AS tab, year(ts) AS y, quarter(ts) AS q FROM events UNION ALL SELECT 'orders', year(o_orderdate), quarter(o_orderdate) FROM orders)
 SELECT tab, CAST(CASE WHEN count(DISTINCT y * 10 + q) = 1 THEN min(y) ELSE -1 END AS INT) AS year, CAST(CASE WHEN count(DISTINCT y * 10 + q) = 1 THEN min(q) ELSE -1 END AS INT) AS quarter, count(DISTINCT y * 10 + q) AS n_quarters FROM q GROUP BY tab""")
def single_period_or_null(spark, d):
    from ..operators.views import single_period

    e = table(spark, d, "events").select(F.lit("events").alias("tab"), F.col("ts").alias("day"))
    o = table(spark, d, "orders").select(F.lit("orders").alias("tab"), F.col("o_orderdate").alias("day"))
    # -1 stands for null here, so that whole numbers stay whole in any reader
    return single_period(e.unionByName(o), ["tab"], "day").fillna(-1, ["year", "quarter"])


@query("""SELECT 'events' AS name, count(*) AS n, count(DISTINCT event_id) AS n_distinct, count(*) = count(DISTINCT event_id) AS is_unique FROM events UNION ALL
 SELECT 'lineitem', count(*), count(DISTINCT (l_orderkey, l_linenumber)), count(*) = count(DISTINCT (l_orderkey, l_linenumber)) FROM lineitem""")
def uniqueness_check(spark, d):
    a = compare.uniqueness(table(spark, d, "events"), ["event_id"]).withColumn("name", F.lit("events"))
    return a.unionByName(compare.uniqueness(table(spark, d, "lineitem"), ["l_orderkey", "l_linenumber"]).withColumn("name", F.lit("lineitem")))


@query("SELECT DISTINCT o_custkey AS custkey FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal > 0)")
def subset_check(spark, d):
    o = table(spark, d, "orders").select(F.col("o_custkey").alias("custkey"))
    return compare.not_in(o, table(spark, d, "customer").where("c_acctbal > 0").select(F.col("c_custkey").alias("custkey")), "custkey")


@query("SELECT doc_id, 'left' AS side FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels) UNION ALL SELECT doc_id, 'right' FROM labels WHERE doc_id NOT IN (SELECT doc_id FROM documents)")
def set_equality(spark, d):
    return compare.set_difference(table(spark, d, "documents"), table(spark, d, "labels"), "doc_id")


@query(f"WITH {PAID_SQL} SELECT month, CAST(sum(raised) AS DOUBLE) AS a, CAST(sum(raised) AS DOUBLE) + 1 AS b FROM paid GROUP BY month HAVING month LIKE '1997%'")
def payload_diff(spark, d):
    """Two derivations of one rollup, the second with a fault of 1 in some months; sums stay exact, so that the fault shows in any month, however large."""
    p = paid_detail(spark, d)
    exact = lambda c: F.sum(c.cast("decimal(28,2)"))
    a = rollup.rollup(p, ["month"], PAID, total=exact).select("month", F.col("raised").alias("v"))
    finer = rollup.rollup(p, ["month", "channel"], PAID, total=exact).groupBy("month").agg(F.sum("raised").alias("v"))
    b = finer.withColumn("v", F.col("v") + F.when(F.col("month").startswith("1997"), 1).otherwise(0))
    return compare.payload_diff(a, b, ["month"], "v").withColumns({k: F.col(k).cast("double") for k in ("a", "b")})


@query("""WITH n AS (SELECT DISTINCT p_type AS name FROM part), s AS (SELECT DISTINCT substr(p_type, 1, 10 + CAST(p_partkey % 9 AS INT)) AS shown FROM part),
 m AS (SELECT shown, count(name) AS k, min(name) AS one, max(CASE WHEN name = shown THEN name END) AS exact FROM s LEFT JOIN n ON starts_with(name, shown) GROUP BY shown)
 SELECT shown, CASE WHEN exact IS NOT NULL THEN exact WHEN k = 1 THEN one END AS name FROM m""")
def prefix_lookup(spark, d):
    p = table(spark, d, "part")
    names = p.select(F.col("p_type").alias("name")).distinct()
    stem = F.substring("p_type", F.lit(1), (F.lit(10) + F.col("p_partkey") % 9).cast("int"))
    stems = p.select(stem.alias("stem")).distinct().join(names, F.col("stem") == names["name"], "left")
    shown = stems.select(F.when(F.col("name").isNull(), F.concat("stem", F.lit("…"))).otherwise(F.col("stem")).alias("shown"))
    found = compare.by_unique_prefix(shown, names, "shown", "name")
    return found.withColumn("shown", F.regexp_replace("shown", "…$", ""))


@query("""WITH n AS (SELECT c_nationkey, c_name, count(*) AS k FROM customer GROUP BY 1, 2), s AS (SELECT DISTINCT c_nationkey, c_name[1:c_custkey % 19] || '…' AS shown, c_name[1:c_custkey % 19] AS stem FROM customer),
 m AS (SELECT s.c_nationkey, shown, sum(k) AS k, min(c_name) AS one FROM s LEFT JOIN n ON s.c_nationkey = n.c_nationkey AND starts_with(c_name, stem) GROUP BY 1, 2)
 SELECT c_nationkey, shown, CASE WHEN k = 1 THEN one END AS c_name FROM m UNION ALL SELECT DISTINCT c_nationkey, c_name[1:c_custkey % 19], CASE WHEN c_custkey % 19 >= length(c_name) THEN c_name END FROM customer""")
def prefix_lookup_within(spark, d):
    c = table(spark, d, "customer").withColumn("stem", F.substring("c_name", F.lit(1), (F.col("c_custkey") % 19).cast("int")))
    # cut names of any length, down to none, and the same without the sign that they were cut
    shown = c.select("c_nationkey", F.concat("stem", F.lit("…")).alias("shown")).unionByName(c.select("c_nationkey", F.col("stem").alias("shown")))
    return compare.by_unique_prefix(shown, c, "shown", "c_name", ["c_nationkey"])


@query("""WITH q AS (SELECT 'events' AS tab, min(year(ts)) AS y, min(quarter(ts)) AS q FROM events UNION ALL SELECT 'first orders', min(year(o_orderdate)), min(quarter(o_orderdate)) FROM orders
 UNION ALL SELECT 'shipped', min(year(l_shipdate)), min(quarter(l_shipdate)) FROM lineitem)
 SELECT a.tab AS tab_a, CAST(a.y AS INT) AS year_a, CAST(a.q AS INT) AS quarter_a, b.tab AS tab_b, CAST(b.y AS INT) AS year_b, CAST(b.q AS INT) AS quarter_b FROM q a, q b WHERE a.tab < b.tab AND (a.y <> b.y OR a.q <> b.q)""")
def cross_tab_period_guard(spark, d):
    def first(name: str, label: str, day: str) -> DataFrame:
        return table(spark, d, name).agg(F.min(F.year(day)).alias("year"), F.min(F.quarter(day)).alias("quarter")).withColumn("tab", F.lit(label))

    tabs = first("events", "events", "ts").unionByName(first("orders", "first orders", "o_orderdate")).unionByName(first("lineitem", "shipped", "l_shipdate"))
    return compare.period_guard(tabs)


@query(f"WITH {GOAL_SQL} SELECT month, CAST(sum(goal) AS DOUBLE) AS goal, CAST(sum(actual) AS DOUBLE) AS actual, count(*) AS n_channels FROM ga GROUP BY month")
def channel_sum_per_period(spark, d):
    rows = _goal_actual(spark, d)
    return rows.groupBy("month").agg(S.exact_sum("goal").alias("goal"), S.exact_sum("actual").alias("actual"), F.count(F.lit(1)).alias("n_channels"))


@query(f"WITH {GOAL_SQL} SELECT channel, month, CAST(count(*) {_W} AS INT) AS n_cells FROM ga")
def running_lineage_prefix(spark, d):
    rows = _goal_actual(spark, d).withColumn("cell", F.concat_ws("!", "channel", "month"))
    return series.series(rows, "goal", ["channel"], "month", "carry", "cell").select("channel", "month", F.col("n_cells").cast("int").alias("n_cells"))


@query("""WITH t AS (SELECT o_orderkey AS k, '$' || CAST(o_totalprice AS DECIMAL(18,2)) || ' ' AS shown FROM orders UNION ALL SELECT o_orderkey, o_orderstatus || o_custkey FROM orders UNION ALL SELECT o_orderkey, o_orderpriority FROM orders)
 SELECT k, TRY_CAST(regexp_replace(trim(shown), '[,$]', '', 'g') AS DOUBLE) AS strict, TRY_CAST(nullif(regexp_replace(shown, '[^0-9.-]', '', 'g'), '') AS DOUBLE) AS loose FROM t""")
def strict_and_shown_numbers(spark, d):
    """What an auditor takes for a number and what a displayed figure shows: prices as money, names with digits, and a digit with a word."""
    o = table(spark, d, "orders")
    money = o.select(F.col("o_orderkey").alias("k"), F.concat(F.lit("$"), F.col("o_totalprice").cast("decimal(18,2)").cast("string"), F.lit(" ")).alias("shown"))
    names = o.select("o_orderkey", F.concat("o_orderstatus", F.col("o_custkey").cast("string"))).union(o.select("o_orderkey", "o_orderpriority"))
    return money.union(names).select("k", S.strict_number("shown").alias("strict"), S.shown_number("shown").alias("loose"))


@query("""WITH t AS (SELECT CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) AS raised, count(*) AS n FROM orders) SELECT raised, n AS n_donations, CASE WHEN n <> 0 THEN raised / n END AS average FROM t""")
def hero_figures(spark, d):
    t = table(spark, d, "orders").agg(S.exact_sum("o_totalprice").alias("raised"), F.count(F.lit(1)).alias("n_donations"))
    return t.withColumn("average", F.try_divide("raised", "n_donations"))


@query("""SELECT o_orderkey, o_totalprice, row_number() OVER (ORDER BY o_totalprice DESC, o_orderkey) AS place
 FROM (SELECT o_orderkey, CASE WHEN o_orderstatus <> 'P' THEN o_totalprice END AS o_totalprice FROM orders)""")
def leaderboard_places(spark, d):
    """The place of each order by its price, those without one last; no task sees more than its range."""
    o = table(spark, d, "orders").select("o_orderkey", F.when(F.col("o_orderstatus") != "P", F.col("o_totalprice")).alias("o_totalprice"))
    return ordinals(o, [F.desc_nulls_last("o_totalprice")], "o_orderkey", "place")


@query("""SELECT o_orderkey, CASE WHEN o_orderstatus <> 'P' THEN o_totalprice END AS step,
 CASE WHEN o_orderstatus <> 'P' THEN CAST(sum(CASE WHEN o_orderstatus <> 'P' THEN CAST(o_totalprice AS DECIMAL(18,2)) ELSE 0 END) OVER (ORDER BY o_orderkey) AS DOUBLE) END AS running_total,
 o_orderstatus = 'P' AS pending FROM orders""")
def running_total_long(spark, d):
    """One series over all orders, in as many tasks as there are ranges."""
    o = table(spark, d, "orders").select(F.lit("all").alias("series"), "o_orderkey", F.when(F.col("o_orderstatus") != "P", S.money("o_totalprice")).alias("v"))
    r = series.long_series(o, "v", ["series"], "o_orderkey", "pending")
    return r.select("o_orderkey", F.col("step").cast("double").alias("step"), F.col("running_total").cast("double").alias("running_total"), "pending")
