import os

from tallyloom.plans.report import build
from tallyloom.sources.workbook import read_cells
from tallyloom.streaming.landing import ARRIVED, ingest, latest

from . import workbooks as wb


def test_landing(spark, tmp_path):
    folder, table, log = tmp_path / "in", str(tmp_path / "cells"), str(tmp_path / "log")
    folder.mkdir()
    (folder / "a.xlsx").write_bytes(wb.workbook({"High-Dollar Donations": wb.high_dollar()}))
    (folder / "bad.xlsx").write_bytes(b"no workbook")
    ingest(spark, str(folder), table, log).awaitTermination()
    first = spark.read.schema(ARRIVED).parquet(table)
    assert first.where("problem IS NOT NULL").count() == 1
    assert sorted(map(str, latest(first).collect())) == sorted(map(str, read_cells(spark, str(folder / "a.xlsx")).collect()))
    # a newer version in another folder level replaces the first; files already seen do not come again
    (folder / "v2").mkdir()
    cells = wb.high_dollar()
    cells["D5"] = 2500.0
    path = folder / "b.xlsx"
    path.write_bytes(wb.workbook({"High-Dollar Donations": cells}))
    os.utime(path, (2_000_000_000, 2_000_000_000))
    ingest(spark, str(folder), table, log).awaitTermination()
    both = spark.read.schema(ARRIVED).parquet(table)
    assert both.where("problem IS NOT NULL").count() == 1 and latest(both).select("workbook").distinct().count() == 2
    r = build(spark, latest(both).where("workbook LIKE '%/b.xlsx'"), "b.xlsx")
    assert r.tabs["high_dollar"].tables["quarter_to_date"].first()["amount"] == 30500


def test_scans_are_pruned(spark):
    """Only the columns that a query needs are read, and filters reach the scan."""
    from tallyloom.plans.queries import QUERIES

    d = "/root/testdata/sf0.001"
    if not os.path.isdir(d):
        return
    plan = lambda n: QUERIES[n](spark, d)._jdf.queryExecution().executedPlan().toString()
    month = plan("rollup_month_ratios")
    assert "l_tax" not in month and "l_returnflag" not in month and month.count("Exchange hashpartitioning") == 1
    assert "PushedFilters: [IsNotNull(o_orderstatus), EqualTo(o_orderstatus,P)" in plan("dormant_channels")
    sets = plan("rollup_grouping_sets")
    assert "Expand" in sets and sets.count("FileScan parquet") == 2
    for name in QUERIES:
        assert "Python" not in plan(name) and "CartesianProduct" not in plan(name), name


def test_a_refused_version_changes_nothing(spark, tmp_path):
    """Good, then broken and unreadable ones, then a better and an older one: the figures are always those of the last good version."""
    from pyspark.sql import functions as F

    from tallyloom.streaming.landing import DECIDED, reload, standing

    folder, table, log = tmp_path / "in", str(tmp_path / "decided"), str(tmp_path / "log")

    def arrives(version, at, sheets):
        (folder / version).mkdir(parents=True)
        path = folder / version / "report.xlsx"
        path.write_bytes(sheets if isinstance(sheets, bytes) else wb.workbook(sheets))
        os.utime(path, (at, at))
        reload(spark, str(folder / "*"), table, log).awaitTermination()
        decided = spark.read.schema(DECIDED).parquet(table)
        cells = standing(read_cells(spark, str(folder / version) if version == "v1" else str(folder / "v[15]")), decided)
        assert cells.select("workbook").distinct().count() == 1
        return {r["path"].split("/")[-2]: r for r in decided.collect()}, cells.where("ref = 'D5'").first()["v_num"]

    good = wb.high_dollar()
    _, amount = arrives("v1", 1_000_000_000, {"High-Dollar Donations": good})
    assert amount == 1500
    (folder / "v5").mkdir()  # for the pattern of paths
    told, amount = arrives("v2", 1_000_000_100, {"High-Dollar Donations": {"A1": "nothing"}})
    assert amount == 1500 and not told["v2"]["accepted"] and "No header row" in told["v2"]["reason"] and told["v2"]["current"].endswith("v1/report.xlsx")
    told, amount = arrives("v3", 1_000_000_200, b"PK no workbook")
    assert amount == 1500 and "directory" in told["v3"]["reason"]
    (folder / "v5").rmdir()
    told, amount = arrives("v5", 1_000_000_300, {"High-Dollar Donations": {**good, "D5": 99.0}})
    assert amount == 99 and told["v5"]["accepted"]
    told, amount = arrives("v6", 1_000_000_050, {"High-Dollar Donations": good})
    assert amount == 99 and "newer" in told["v6"]["reason"]
    assert F is not None and len(told) == 5
