import datetime as dt

import pytest
from pyspark.sql import functions as F

from tallyloom.functions import semantics as S
from tallyloom.operators import compare, reconcile, rollup, series, views
from tallyloom.operators.catalog import Catalog, Metric, accumulated, by_name, by_table, catalog, kind_of, norm_text, slug_text


def each(spark, f, values, kind="string"):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    return [r["o"] for r in rows.select("i", f("v").alias("o")).orderBy("i").collect()]


def test_numbers(spark):
    texts = ["$1,234.50", "20%", "12abc", "(5)", "-", "#DIV/0!", "", " -3.5e2x", ".5", None, "+7"]
    assert each(spark, S.lenient_number, texts) == [1234.5, 20, 12, None, None, None, None, -350, 0.5, None, 7]
    assert each(spark, S.strict_number, ["$1,234.5", "20%", "x", None]) == [1234.5, None, None, None]
    assert each(spark, S.shown_number, ["$1,234.50 up", "–", None]) == [1234.5, None, None]
    assert each(spark, S.number_text, [7.0, 1e7, 0.25, -0.5, None], "double") == ["7", "10000000", "0.25", "-0.5", None]
    assert each(spark, S.short_number, [3.14159, 0.5, 0.1234567, None, -2.0], "double") == ["3.14", "0.5", "0.123457", "—", "-2.00"]


def test_names(spark):
    labels = ["  Gross  Spend: ", "client :", "4-NOT SPECIFIED", None, "Rate::", "_x_"]
    assert each(spark, S.norm, labels) == ["gross spend", "client ", "4-not specified", "", "rate:", "_x_"] == [norm_text(x) for x in labels]
    assert each(spark, S.slug, labels) == [slug_text(x) for x in labels]
    kinds = {"Total ROAS": "roas", "Donate Rate": "rate", "Rates": "usd", "Gross CPA": "usd2", "NTL": "count", "Discount": "count", "Unsub": "count", "Raised": "usd", "Average ROAS": "roas"}
    assert each(spark, S.metric_kind, list(kinds)) == list(kinds.values()) == [kind_of(x) for x in kinds]


def test_references_and_dates(spark):
    assert each(spark, S.column_number, ["A", "Z", "AA", "XFD"]) == [1, 26, 27, 16384]
    assert each(spark, S.column_letters, [1, 26, 27, 702, 703, 16384], "int") == ["A", "Z", "AA", "ZZ", "AAA", "XFD"]
    assert each(spark, S.cell_row, ["B12", "12", "b1"]) == [12, None, None]
    assert each(spark, S.serial_date, [46237.0, 60.0, 1.0, None], "double") == [dt.date(2026, 8, 3), dt.date(1900, 2, 28), dt.date(1899, 12, 31), None]
    assert each(spark, lambda v: S.month_label(S.serial_date(v)), [46237.0], "double") == ["August 2026"]
    assert each(spark, S.quarter_label, [3.0, 2.5], "double") == ["Q3", "Q3"]


def test_flags_and_ratios(spark):
    rows = spark.createDataFrame([("boolean", None, None, True), ("number", None, 2.0, None), ("number", None, 0.0, None), ("string", " true ", None, None), ("string", "yes", None, None), (None, None, None, None)], "kind string, v_str string, v_num double, v_bool boolean")
    assert [r[0] for r in rows.select(S.cell_flag()).collect()] == [True, True, False, True, False, False]
    pairs = spark.createDataFrame([(1.0, 2.0), (1.0, 0.0), (1.0, None), (None, 5.0), (None, None)], "n double, d double")
    assert [r[0] for r in pairs.select(S.ratio("n", "d")).collect()] == [0.5, None, None, 0.0, None]
    assert [r[0] for r in pairs.select(S.near("n", "d", 1.0)).collect()] == [True, True, False, False, False]
    assert [r[0] for r in pairs.select(S.close("n", "d", 1.0)).collect()] == [True, True, False, False, True]


def test_catalog():
    cat = catalog([("Gross Spend", "F"), ("NTL", "G"), ("Gross CPA", "H"), ("Immediate Raised", "I"), ("Immediate ROAS", "J"), ("ROAS", "K"), ("Gross  Spend", "L")], by_name)
    assert [(m.key, m.numerator, m.denominator) for m in cat.ratios] == [("gross_cpa", "gross_spend", "ntl"), ("immediate_roas", "immediate_raised", "gross_spend"), ("roas", None, None)]
    assert cat.keys()[-1] == "gross_spend_2" and cat.get("roas").unresolvable
    keys, text = accumulated(cat, ["gross_spend", "ntl", "total_raised"], fallback=True)
    assert keys == ["gross_spend", "ntl", "immediate_raised"] and "instead" in text
    assert by_table({"a": ("b", "c")})("a", ["b"]) is None


@pytest.mark.parametrize(("policy", "totals", "steps"), [("pending", [5, None, 12], [5, None, 7]), ("carry", [5, 5, 12], [5, None, 7]), ("zero", [5, 5, 12], [5, 0, 7])])
def test_null_policies(spark, policy, totals, steps):
    rows = spark.createDataFrame([("a", 1, 5, "A1"), ("a", 2, None, "A2"), ("a", 3, 7, "A3")], "k string, o int, v int, cell string")
    got = series.series(rows, "v", ["k"], "o", policy, "cell").orderBy("o").collect()
    assert [r["running_total"] for r in got] == totals and [r["step"] for r in got] == steps
    assert [r["pending"] for r in got] == [policy == "pending" and s is None for s in steps] and [(r["n_cells"], r["step_cell"]) for r in got] == [(1, "A1"), (2, "A2"), (3, "A3")]
    with pytest.raises(ValueError):
        series.running("v", ["k"], "o", "other")


def test_null_sums_and_levels(spark):
    cat = Catalog([Metric("a", "A", "usd"), Metric("b", "B", "count"), Metric("r", "R", "usd2", None, "a", "b")])
    rows = spark.createDataFrame([("x", None, None), ("x", None, 2.0), ("y", 3.0, 0.0), (None, 1.0, 1.0)], "g string, a double, b double")
    got = {r["g"]: r for r in rollup.rollup(rows, ["g"], cat).collect()}
    assert (got["x"]["a"], got["x"]["r"], got["y"]["r"], got[None]["r"]) == (None, 0.0, None, 1.0)
    sets = rollup.rollup_sets(rows, [["g"], []], cat).collect()
    assert sorted((r["level"], str(r["g"]), r["row_count"]) for r in sets) == [(0, "None", 1), (0, "x", 2), (0, "y", 1), (1, "None", 4)]
    assert rollup.year_to_date(rows.where("g = 'x'"), cat).first()["a"] == 0


def test_reconcile(spark):
    rows = spark.createDataFrame([(i, 10.0, 2.0, 5.0 if i % 3 else 6.0, f"C{i}") for i in range(30)] + [(99, None, 2.0, 1.0, "C99"), (98, 1.0, 0.0, None, "C98"), (97, 1.0, 1.0, None, "C97")], "row int, n double, d double, s double, cell string")
    r = reconcile.identity(rows, reconcile.Identity("X", "s", "n", "d", "S", "n / d"), cell="cell").first()
    assert (r["n_checked"], r["n_bad"], r["more_cells"]) == (31, 11, 5)
    assert r["cells"][:2] == ["C0 shows 6.00, components give 5.00", "C3 shows 6.00, components give 5.00"]
    tabs = spark.createDataFrame([("a",), ("b",)], "tab string")
    problems = spark.createDataFrame([("a", "error"), ("b", "flag")], "tab string, level string")
    assert [x["tab"] for x in reconcile.publishable(tabs, problems).collect()] == ["b"]


def test_views_and_compare(spark):
    rows = spark.createDataFrame([("r", "x", 1.0), ("r", "y", 2.0), ("s", "x", 5.0)], "channel string, place string, v double")
    assert views.filtered(rows, channel="r", place="all").count() == 2 and views.filtered(rows, channel=None).count() == 3
    board = views.leaderboard(rows, ["channel"], Catalog([Metric("v", "V", "usd")]), "v", totals=True).collect()
    assert [(x["channel"], x["v"], x["level"]) for x in board] == [("s", 5, 0), ("r", 3, 0), (None, 8, 1)]
    assert compare.payload_diff(rows, rows.withColumn("v", F.col("v") * (1 + 1e-12)), ["channel", "place"], "v").count() == 0
    assert compare.payload_diff(rows, rows.where("place = 'x'"), ["channel", "place"], "v").count() == 1
    assert compare.set_difference(rows, rows.where("channel = 's'"), "channel").collect()[0]["side"] == "left"
    assert not compare.uniqueness(rows, ["channel"]).first()["is_unique"]


def test_payload_diff_of_large_amounts(spark, tmp_path):
    import os

    from tallyloom.plans.queries import QUERIES

    rows = spark.sql("SELECT 'x' AS k, CAST(5000000000.00 AS DECIMAL(38,2)) AS v")
    assert compare.payload_diff(rows, rows, ["k"], "v").count() == 0
    assert compare.payload_diff(rows, rows.withColumn("v", F.col("v") + 1), ["k"], "v").count() == 1
    # months of billions: a fault of 1 lies below a billionth of them
    day = "CAST(make_date(1996 + id DIV 12, 1 + id % 12, 3) AS TIMESTAMP) AS l_shipdate"
    spark.range(36).selectExpr(day, "CASE WHEN id % 2 = 0 THEN 'A' ELSE 'N' END AS l_returnflag", "'O' AS l_linestatus", "1.0D AS l_quantity", "4000000000.25D AS l_extendedprice", "0.01D AS l_discount").write.parquet(os.fspath(tmp_path / "lineitem.parquet"))
    found = QUERIES["payload_diff"](spark, os.fspath(tmp_path)).collect()
    assert sorted((r["month"], r["a"], r["b"]) for r in found) == [(f"1997-{m:02}", 4000000000.25, 4000000001.25) for m in range(1, 13)]
