from pyspark.sql import functions as F

from tallyloom.operators import verify
from tallyloom.operators.discover import typed
from tallyloom.operators.lineage import cells_of as spelled
from tallyloom.plans.report import build
from tallyloom.plans.tabs import lineage

from . import workbooks as wb
from .test_workbook import cells_of


def test_clean_report_and_controls(spark):
    r = build(spark, cells_of(spark, wb.everything()), "x")
    t = r.tabs
    assert verify.digital(t["digital"]).count() == 0
    assert verify.paid(t["paid"]).count() == 0
    assert verify.flat(t["p2p"]).count() == 0 and verify.flat(t["email"], "label").count() == 0 and verify.flat(t["high_dollar"], "receipt_id").count() == 0
    cells = typed(r.cells.where("sheet = 'Digital Report'"))
    table = t["digital"].tables["channel_period"]
    claims = table.select(F.explode(F.array(*[F.struct(F.col(f"{f}_cell").alias("cell"), F.col(f).alias("value")) for f in ("goal", "actual", "pct")])).alias("c")).select("c.*")
    assert claims.count() == 9 * 4 * 3 and verify.provenance(claims, cells).count() == 0
    assert verify.provenance(claims.withColumn("value", F.col("value") + 1), cells).count() > 50
    # negative controls: broken tables must be found
    tab = t["p2p"]
    tab.tables["monthly"] = tab.tables["monthly"].withColumn("gross_spend", F.col("gross_spend") + 1)
    assert {x["check"] for x in verify.flat(tab).collect()} >= {"months sum to the quarter", "monthly: gross_cpa is rebuilt", "a series ends at its total"}
    naive = tab.tables["detail"].agg(F.avg("gross_cpa")).first()[0]
    assert abs(naive - tab.tables["quarter_to_date"].first()["gross_cpa"]) > 0.01


def test_lineage(spark):
    cells = cells_of(spark, {"P2P Statistics": wb.p2p()[0]})
    tab = build(spark, cells, "x").tabs["p2p"]
    line = lineage(tab)
    keys = [m.key for m in tab.catalog.additive]
    assert verify.computed_provenance(line, typed(cells), keys).count() == 0
    july = {r["metric_key"]: r for r in line.where("month_key = 'july'").withColumn("cells", spelled("runs")).collect()}
    assert july["gross_spend"]["cells"] == [f"E{5 + i}" for i in range(0, 24, 2)]
    assert july["gross_cpa"]["cells"][:12] == july["gross_spend"]["cells"] and july["gross_cpa"]["value"] == july["gross_spend"]["value"] / july["ntl"]["value"]
    assert verify.computed_provenance(line.withColumn("value", F.col("value") + 1), typed(cells), keys).count() == 2 * len(keys)


def test_audit_and_guard(spark, tmp_path):
    import json

    import pytest

    from tallyloom.sources.snapshots import without_data

    r = build(spark, cells_of(spark, wb.everything()), "x")
    paths = r.write(str(tmp_path), paths={"paid": str(tmp_path / "elsewhere" / "pm.json")})
    assert any(p.endswith("elsewhere/pm.json") for p in paths)
    docs = spark.createDataFrame([(p, open(p).read(), "x.xlsx") for p in paths], "path string, document string, workbook string")
    assert all(json.loads(open(p).read())["meta"]["built_at"].endswith("+00:00") for p in paths)
    cells = typed(r.cells)
    said = {x["doc"]: x["n"] for x in verify.claims(docs).groupBy("doc").agg(F.count(F.lit(1)).alias("n")).collect()}
    assert len(said) == 5 and min(said.values()) == 7 and sum(said.values()) > 800  # seven donations, and far more elsewhere
    assert verify.audit(docs, cells).count() == 0
    other = verify.audit(docs, cells.withColumn("num", F.col("num") * 2 + 1)).groupBy("doc").agg(F.count(F.lit(1)).alias("n"))
    assert {x["doc"] for x in other.collect()} == set(paths)
    clean, leaky, filled = tmp_path / "a.html", tmp_path / "b.html", tmp_path / "c.html"
    clean.write_text("<script>let DATA = null; const x = {a: 1}; /* quarter_to_date */</script>")
    leaky.write_text('<script>let DATA = null; load({"quarter_to_date": []})</script>')
    filled.write_text('<script>let DATA = {"a": 1};</script>')
    without_data(str(clean), paths)
    for bad in (leaky, filled):
        with pytest.raises(ValueError, match="holds data"):
            without_data(str(bad), paths)
    r.close()


def test_claims_of_nested_documents(spark):
    """Pairs at any depth, flags, texts, blanks, formulas, lists of cells; no pair across objects; what is nested too deep is told."""
    text = '{"a": {"goal": 1.5, "goal_cell": "B2", "goal_formula": "=A1", "x": [{"value": null, "cell": "C3"}, {"value": true, "cell": "D4"}]}, "term": "NTL", "term_cell": "F4", "cell": "Z9", "s": {"step_cells": ["A1", "A2"], "running_total": 7}}'
    docs = spark.createDataFrame([("d", text), ("bad", "no json"), ("none", None), ("list", '[{"value": 2, "cell": "A1"}]')], "path string, document string")
    got = sorted(tuple(r) for r in verify.claims(docs).select("doc", "path", "cell", "kind").collect())
    assert got == [
        ("d", ".a.goal", "B2", "formula"), ("d", ".a.goal", "B2", "number"), ("d", ".a.x[0].value", "C3", "number"), ("d", ".a.x[1].value", "D4", "flag"),
        ("d", ".s.running_total", "A1", "sum"), ("d", ".s.running_total", "A2", "sum"), ("d", ".term", "F4", "text"), ("list", "[0].value", "A1", "number"),
    ]
    assert verify.leaves(docs, 2).where("kind = 'deep'").count() > 0 and verify.leaves(docs).where("kind = 'deep'").count() == 0


def test_one_workbook_for_a_report(spark, tmp_path):
    import pytest

    from tallyloom.plans.report import load, load_all

    for folder in ("a", "b"):
        (tmp_path / folder).mkdir()
        (tmp_path / folder / "same.xlsx").write_bytes(wb.workbook({"High-Dollar Donations": wb.high_dollar()}))
    with pytest.raises(ValueError, match="several workbooks"):
        load(spark, str(tmp_path / "*"))
    made = [r.workbook for r in load_all(spark, str(tmp_path / "*"))]
    assert len(made) == 2 and made[0].endswith("a/same.xlsx") and made[1].endswith("b/same.xlsx")


def test_prefixes_of_any_length(spark):
    from tallyloom.operators.compare import by_unique_prefix

    names = spark.createDataFrame([("Meta Ads", "July"), ("Connected TV", "July"), ("Connected TV Max", "August"), ("X", "July")], "name string, month string")
    shown = spark.createDataFrame([("Meta", "July"), ("Me…", "July"), ("Connected T…", "July"), ("Connected T…", "August"), ("X", "July"), ("…", "July"), (None, "July")], "shown string, month string")
    got = {(r["shown"], r["month"]): r["name"] for r in by_unique_prefix(shown, names, "shown", "name", ["month"]).collect()}
    assert got == {("Meta", "July"): None, ("Me…", "July"): "Meta Ads", ("Connected T…", "July"): "Connected TV", ("Connected T…", "August"): "Connected TV Max", ("X", "July"): "X", ("…", "July"): None}


def test_all_quarters_are_named(spark):
    cells = wb.high_dollar()
    for i in range(8):
        cells[f"C{5 + i}"] = 46204 + 95 * i
    t = build(spark, cells_of(spark, {"High-Dollar Donations": cells}), "x").tabs["high_dollar"]
    text = next(p["text"] for p in t.problems if "several quarters" in p["text"])
    assert text.count("Q") == 8 and t.meta == {"year": None, "quarter": None}


def test_checks_take_a_fixed_number_of_tasks(spark):
    tab = build(spark, cells_of(spark, {"P2P Statistics": wb.p2p()[0]}), "x").tabs["p2p"]
    found = verify.flat(tab, required=("month", "topic"), unresolvable=())
    assert found.rdd.getNumPartitions() <= 8
    assert {r["check"] for r in found.collect()} <= {"the ratios without components are the known ones"}
