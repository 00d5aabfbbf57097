"""From a workbook to a reconciled report: `load(spark, path)`, then `Report.write`."""

from __future__ import annotations


from collections.abc import Iterator
from dataclasses import dataclass, field
from datetime import UTC, datetime

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from ..operators import reconcile
from ..operators.reconcile import PROBLEM
from ..sources.documents import publish
from ..sources.scratch import materialize
from ..sources.snapshots import snapshot
from ..sources.workbook import read_cells
from .layout import NAMES, TABS, of_workbook
from .many import Reports
from .tabs import Tab, tab_of

class Refused(RuntimeError):
    """A strict report has errors, so nothing is written."""


@dataclass
class Report:
    spark: SparkSession
    workbook: str
    cells: DataFrame
    tabs: dict[str, Tab] = field(default_factory=dict)
    findings: list[str] = field(default_factory=list)
    #: cached tables that all others read
    held: list[DataFrame] = field(default_factory=list)

    @property
    def problems(self) -> DataFrame:
        rows = [(p["tab"], p["level"], p["rule_id"], p["text"], p.get("sections", []), p.get("cells", []), p.get("more_cells", 0), i) for i, p in enumerate(p for t in self.tabs.values() for p in t.problems)]
        return self.spark.createDataFrame(rows, PROBLEM)

    @property
    def counts(self) -> dict[str, int]:
        levels = [p["level"] for t in self.tabs.values() for p in t.problems]
        return {k: levels.count(k) for k in ("error", "warn", "flag")}

    @property
    def published(self) -> DataFrame:
        """(tab) of each tab without an error."""
        names = self.spark.createDataFrame([(k,) for k in self.tabs], "tab string")
        return reconcile.publishable(names, self.problems)

    @property
    def shown(self) -> dict[str, Tab]:
        """Tabs without an error."""
        names = {r["tab"] for r in self.published.collect()}
        return {k: t for k, t in self.tabs.items() if k in names}

    def close(self) -> None:
        """Let cached tables go; the report's tables can still be read."""
        for rows in self.held:
            rows.unpersist()

    def log(self) -> list[str]:
        out = [f"[{t.name}] {x}" for t in self.tabs.values() for x in t.findings]
        for t in self.tabs.values():
            for p in t.problems:
                more = f" …and {p['more_cells']} more" if p.get("more_cells") else ""
                out.append(f"[{p['tab']}] {p['level'].upper()}: {p['text']}" + (f" ({'; '.join(p['cells'])}{more})" if p.get("cells") else ""))
        return out

    def write(self, folder: str, strict: bool = True, paths: dict[str, str] | None = None) -> list[str]:
        """A JSON snapshot of each tab, in the folder or where `paths` says for a tab, all published together or none. strict: any error, and nothing is written; else tabs with errors are left out."""
        if strict and self.counts["error"]:
            raise Refused("; ".join(p["text"] for t in self.tabs.values() for p in t.problems if p["level"] == "error"))
        out = {}
        for name, t in self.shown.items():
            meta = {**t.meta, "sheet": t.sheet, "source_workbook": self.workbook, "built_at": datetime.now(UTC).isoformat(timespec="seconds")}
            parts = {"meta": meta, **{k: v for k, v in t.tables.items()}, **t.lists, "findings": t.findings, "problems": t.problems}
            out[(paths or {}).get(name) or f"{folder}/{name.replace('_', '-')}-data.json"] = snapshot(parts)
        publish(self.spark.createDataFrame(list(out.items()), "path string, document string"), folder)
        return list(out)


def _reports(reports: Reports, layout: list, named: str | None = None) -> Iterator[Report]:
    """A report of each workbook in the layout; what is said of a workbook comes to the driver, its tables stay where they are."""
    books = list(dict.fromkeys(r["workbook"] for r in layout))
    of = lambda rows, b: [r for r in rows if r["workbook"] == b]
    only = books[0] if len(books) == 1 else None
    for book in books:
        mine = lambda rows: rows if only else rows.where(F.col("workbook") == book)  # noqa: E731, B023
        told = sorted(mine(reports.told).collect(), key=lambda r: r["at"])
        lists = mine(reports.lists()).collect()
        problems, findings, periods = ([r for r in told if r["kind"] == k] for k in ("problem", "finding", "period"))
        rows, channels = mine(reports.rows), mine(reports.channel_period)
        own = of(layout, book)
        n = next(int(r["num"]) for r in own if r["kind"] == "tab")
        report = Report(reports.spark, named or book, mine(reports.source), findings=[f"Workbook has {n} tab(s)."])
        for spec in TABS:
            pick = lambda x: [r for r in x if r["tab"] == spec.name]  # noqa: E731, B023
            report.tabs[spec.name] = tab_of(reports, spec.name, pick(own), pick(problems), pick(findings), pick(lists), next(iter(pick(periods)), None), rows, channels)
        yield report


def build(spark: SparkSession, cells: DataFrame, workbook: str) -> Report:
    """A report from a table of cells of one workbook; cells of several are an error."""
    held: list[DataFrame] = []

    def keep(rows: DataFrame, name: str) -> DataFrame:
        held.append(rows.cache())
        return held[-1]

    cells = keep(cells, "cells")
    reports = Reports(cells, keep, one=True)
    layout = reports.layout.collect()  # of one workbook: a few rows for each column of its tabs
    if len({r["workbook"] for r in layout}) > 1:
        raise ValueError("these cells are of several workbooks; load_all makes a report of each")
    if not layout:
        layout = [Row(**dict(zip(NAMES, r, strict=True))) for r in of_workbook(workbook, [])]
        report = Report(spark, workbook, cells, {t.name: Tab(t.name) for t in TABS})
        for r in layout:
            if r["kind"] == "problem":
                report.tabs[r["tab"]].problems.append({"tab": r["tab"], "level": r["field"], "rule_id": "RC13", "text": r["txt"]})
    else:
        report = next(_reports(reports, layout, workbook))
    report.held = held
    return report


def load(spark: SparkSession, path: str) -> Report:
    """Read, extract and reconcile. The new report is a value of its own: one that is refused leaves others as they are."""
    return build(spark, read_cells(spark, path), path.rsplit("/", 1)[-1])


def load_many(spark: SparkSession, path: str) -> Reports:
    """The reports of all workbooks of a folder or pattern as tables keyed by workbook (its whole path), in a number of jobs that does not grow with them."""
    return Reports(materialize(read_cells(spark, path), "cells"))


def load_all(spark: SparkSession, path: str) -> Iterator[Report]:
    """A report value for each workbook of a folder or pattern, by whole path. All are read and extracted at once (`load_many`); only what is said of a workbook is fetched one by one."""
    reports = load_many(spark, path)
    books = reports.layout.select("workbook").distinct().orderBy("workbook")
    for r in books.toLocalIterator():
        yield from _reports(reports, reports.layout.where(F.col("workbook") == r["workbook"]).collect())
