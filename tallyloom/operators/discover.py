"""Finding tables inside sheets by their labels and headers.

Headings are looked for in the first MAX_SCAN rows, which come to the driver once as a small grid. Everything below a header stays a
DataFrame: the end of a block, the test whether a column is numeric, and the rows themselves.
"""

from __future__ import annotations

import re
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import semantics as S
from ..functions.semantics import MAX_SCAN
from ..sources.workbook import column_letters, column_number
from .catalog import norm_text


def typed(cells: DataFrame) -> DataFrame:
    """Cells with their text, lenient number and lenient flag."""
    return cells.where("kind <> 'sheet'").withColumns({"txt": S.cell_text(), "num": S.cell_number(), "flag": S.cell_flag()})


#: Rows that are read below the deepest heading: its columns' headers and the first row.
BELOW = 2


@dataclass(frozen=True)
class Header:
    key: str
    label: str
    col: int

    @property
    def letters(self) -> str:
        return column_letters(self.col)


class Grid:
    """The first rows of a sheet on one machine: (row, col) -> a cell's txt, num, flag and formula."""

    def __init__(self, name: str, grid: dict, max_scan: int = MAX_SCAN):
        self.name, self.grid, self.max_scan = name, grid, max_scan
        self.max_col = max((c for _, c in grid), default=0)

    def text(self, row: int, col: int | str) -> str | None:
        r = self.grid.get((row, column_number(col) if isinstance(col, str) else col))
        return r["txt"] if r else None

    def find_row(self, col: int | str, pattern: str, limit: int | None = None) -> int:
        """The first row of a column whose normalised text matches, or 0; no limit, or 0, means the full depth."""
        c = column_number(col) if isinstance(col, str) else col
        rows = sorted(r for r, k in self.grid if k == c and r <= (limit or self.max_scan))
        return next((r for r in rows if re.search(pattern, norm_text(self.text(r, c)))), 0)

    def labelled(self, label_col: str, value_col: str, pattern: str) -> dict | None:
        """The cell beside a label: text, num, cell."""
        row = self.find_row(label_col, pattern)
        if not row:
            return None
        r = self.grid.get((row, column_number(value_col)))
        return {"text": r["txt"] if r else None, "num": r["num"] if r else None, "cell": f"{value_col}{row}"}

    def headers(self, row: int, first: int | str, last: int | str) -> list[Header]:
        """The header row's columns in order; of equal names the first stays."""
        a, b = (column_number(x) if isinstance(x, str) else x for x in (first, last))
        out: dict[str, Header] = {}
        for col in range(a, b + 1):
            label = self.text(row, col)
            if label is not None:
                out.setdefault(norm_text(label), Header(norm_text(label), label, col))
        return list(out.values())

    def header_row(self, names: Sequence[str]) -> int:
        """The first row that has all these names."""
        by_row: dict[int, set[str]] = {}
        for (row, _), r in self.grid.items():
            by_row.setdefault(row, set()).add(norm_text(r["txt"])) if row <= self.max_scan else None
        return min((row for row, have in by_row.items() if set(names) <= have), default=0)


class Sheet(Grid):
    """One sheet: `cells` (typed), and the grid of its first rows."""

    def __init__(self, name: str, cells: DataFrame, max_scan: int = MAX_SCAN):
        rows = cells.where((F.col("row") <= max_scan + BELOW) & (F.col("txt").isNotNull() | F.col("formula").isNotNull())).select("row", "col", "txt", "num", "flag", "formula").collect()
        super().__init__(name, {(r["row"], r["col"]): r for r in rows}, max_scan)
        self.cells = cells
        extent = cells.agg(F.max("col").alias("col"), F.max("row").alias("row")).first()
        self.max_col, self.max_row = extent["col"] or 0, extent["row"] or 0


def block(sheet: Sheet, after: int, cols: Sequence[int], numeric: bool = False, until: str | None = None) -> DataFrame:
    """Rows of the contiguous block below a row: it ends where all of `cols` are blank (or not numbers), or where `until` stands."""
    value = F.col("num") if numeric else F.col("txt")
    filled = sheet.cells.where((F.col("row") > after) & F.col("col").isin(*cols) & value.isNotNull())
    if until:
        filled = filled.where(~S.norm("txt").rlike(until))
    rows = filled.select("row").distinct()
    # the block ends after the first row whose next row is missing
    ends = rows.join(rows.select((F.col("row") - 1).alias("row")), "row", "left_anti").agg(F.min("row").alias("end"))
    starts = rows.where(F.col("row") == after + 1).select(F.lit(1).alias("one"))
    bound = F.broadcast(ends.crossJoin(starts))  # one row, or none
    return rows.join(bound, rows["row"] <= bound["end"]).select("row")


def numeric_columns(sheet: Sheet, after: int, cols: Sequence[int]) -> dict[int, bool]:
    """Whether every filled cell below a row is a number; a column without any is not."""
    below = sheet.cells.where((F.col("row") > after) & F.col("col").isin(*cols) & F.col("txt").isNotNull())
    found = {r["col"]: r["ok"] for r in below.groupBy("col").agg(F.bool_and(F.col("num").isNotNull()).alias("ok")).collect()}
    return {c: bool(found.get(c, False)) for c in cols}
