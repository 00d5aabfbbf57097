"""python -m tallyloom.plans WORKBOOK FOLDER [--lenient] [--path TAB=FILE ...]: snapshots of a workbook's tabs. Exit 1: errors; 2: no such file."""

from __future__ import annotations

import argparse
import os
import sys

from pyspark.sql import SparkSession

from ..session import ship
from ..sources.workbook import WorkbookError
from .layout import TABS
from .report import Refused, load


def main() -> int:
    p = argparse.ArgumentParser(description=__doc__)
    p.add_argument("workbook")
    p.add_argument("folder")
    p.add_argument("--lenient", action="store_true", help="write the tabs without errors even if others have some")
    p.add_argument("--path", action="append", default=[], metavar="TAB=FILE", help="where the snapshot of a tab goes, in place of the folder")
    a = p.parse_args()
    paths = dict(x.split("=", 1) for x in a.path if "=" in x)
    if len(paths) < len(a.path) or set(paths) - {t.name for t in TABS}:
        p.error("--path takes TAB=FILE, with one of " + ", ".join(t.name for t in TABS))
    if "://" not in a.workbook and not os.path.exists(a.workbook):
        print(f"no such file: {a.workbook}", file=sys.stderr)
        return 2
    spark = SparkSession.builder.getOrCreate()
    ship(spark)
    try:
        report = load(spark, a.workbook)
        print("\n".join(report.log()))
        print("\n".join(report.write(a.folder, strict=not a.lenient, paths=paths)))
    except (Refused, WorkbookError) as e:
        print(e, file=sys.stderr)
        return 1
    return 0


if __name__ == "__main__":
    sys.exit(main())
