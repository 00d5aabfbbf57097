import os
import shutil
import subprocess
import sys

import __spark_entry__ as entry
from tallyloom.plans import many_queries as many
from tallyloom.plans import queries as reports
from tallyloom.plans import workbook_queries as workbooks

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def test_names():
    assert set(reports.SQL) == set(reports.QUERIES) <= set(entry.queries())
    assert set(workbooks.SQL) == set(workbooks.QUERIES) <= set(entry.queries())
    assert set(many.SQL) == set(many.QUERIES) <= set(entry.queries())
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_the_rest_stands_alone(tmp_path):
    """Without the corpus operators the entry module imports, and nothing else misses them."""
    shutil.copytree(os.path.join(ROOT, "tallyloom"), tmp_path / "tallyloom", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(os.path.join(ROOT, "__spark_entry__.py"), tmp_path)
    code = "import __spark_entry__ as e, tallyloom.plans.report, tallyloom.operators.verify; print(sorted(e.queries()) == sorted(e.oracle_sql()), len(e.queries()))"
    out = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, capture_output=True, text=True, env={**os.environ, "PYTHONPATH": str(tmp_path)})
    assert out.stdout.split() == ["True", str(len(reports.QUERIES) + len(workbooks.QUERIES) + len(many.QUERIES))], out.stderr


def test_report_queries_match_their_sql(spark):
    """A few of the queries against DuckDB at the smallest size."""
    import duckdb

    d = "/root/testdata/sf0.001"
    if not os.path.isdir(d):
        return
    con = duckdb.connect()
    for t in ("customer", "orders", "lineitem", "events", "part", "documents", "labels", "conversations"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{d}/{t}.parquet'")
    for name in ("rollup_month_ratios", "rollup_grouping_sets", "running_total_pending", "series_dense_by_topic", "problem_counts", "flag_top6_and_remainder", "lenient_number_parse"):
        want = con.sql(reports.SQL[name])
        got = reports.QUERIES[name](spark, d)
        cols = sorted(want.columns)
        assert sorted(got.columns) == cols
        a = sorted(str([r[c] for c in cols]) for r in got.collect())
        b = sorted(str([r[want.columns.index(c)] for c in cols]) for r in want.fetchall())
        assert a == b, name
