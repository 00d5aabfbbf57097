"""Workbooks as a table of cells.

`read_cells` loads files with Spark's own binary reader, so any store that Spark reads will do, and parses each in
a task. `XlsxCells` is the same as a data source, `spark.read.format("xlsx_cells").load(path)`, with a partition for each
sheet, for paths that the workers can open.

Differences on purpose: cells of ISO dates (t="d") give the date's day number; phonetic runs are not part of a shared string.
"""

from __future__ import annotations

import datetime as dt
import io
import posixpath
import re
import zipfile
from collections.abc import Iterator
from itertools import batched
from xml.etree import ElementTree as ET
from xml.sax.saxutils import escape, quoteattr

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

CELLS = "workbook string, sheet string, sheet_ord int, row int, col int, ref string, kind string, v_num double, v_str string, v_bool boolean, formula string"

# The namespaces of the file format.
MAIN = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
REL = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}id"


class WorkbookError(ValueError):
    """The file is no workbook that can be read."""


def column_number(letters: str) -> int:
    n = 0
    for x in letters:
        n = n * 26 + ord(x) - 64
    return n


def column_letters(n: int) -> str:
    out = ""
    while n > 0:
        n, r = divmod(n - 1, 26)
        out = chr(65 + r) + out
    return out


def split_ref(ref: str) -> tuple[int, int]:
    """(column, row) of an A1 reference."""
    m = re.fullmatch(r"([A-Z]+)(\d+)", ref)
    if not m:
        raise WorkbookError(f"{ref!r} is no cell reference")
    return column_number(m[1]), int(m[2])


_PARTS = re.compile(r"""(?P<skip>"(?:[^"]|"")*"|'(?:[^']|'')*')|(?<![A-Za-z0-9_.$])(?P<ca>\$?)(?P<col>[A-Z]{1,3})(?P<ra>\$?)(?P<row>\d+)(?![A-Za-z0-9_.(])""")


def translate_formula(text: str, source: str, target: str) -> str:
    """A shared formula's text as its copy in another cell has it: relative references move, `$` holds, text and names stay."""
    (c0, r0), (c1, r1) = split_ref(source), split_ref(target)

    def moved(m: re.Match) -> str:
        if m["skip"] is not None:
            return m[0]
        col = m["col"] if m["ca"] else column_letters(max(1, column_number(m["col"]) + c1 - c0))
        row = m["row"] if m["ra"] else str(max(1, int(m["row"]) + r1 - r0))
        return f"{m['ca']}{col}{m['ra']}{row}"

    return _PARTS.sub(moved, text)


def _open(data: bytes) -> zipfile.ZipFile:
    if data[:2] != b"PK":
        raise WorkbookError("This is not an .xlsx file.")
    if b"PK\x06\x07" in data[-66_000:]:
        raise WorkbookError("This workbook uses ZIP64, which is not supported.")
    try:
        z = zipfile.ZipFile(io.BytesIO(data))
    except zipfile.BadZipFile as e:
        raise WorkbookError(f"The file's directory cannot be read: {e}") from e
    names = set(z.namelist())
    if "EncryptedPackage" in names:
        raise WorkbookError("This workbook is encrypted.")
    if "xl/workbook.xml" not in names:
        raise WorkbookError("This file has no workbook part.")
    return z


def _part(z: zipfile.ZipFile, name: str) -> bytes:
    info = z.getinfo(name)
    if info.flag_bits & 1:
        raise WorkbookError("This workbook is encrypted.")
    if info.compress_type not in (zipfile.ZIP_STORED, zipfile.ZIP_DEFLATED):
        raise WorkbookError(f"Part {name} uses an unknown compression.")
    try:
        return z.read(name)
    except zipfile.BadZipFile as e:
        raise WorkbookError(f"Part {name} cannot be read: {e}") from e


def _runs(item: ET.Element) -> str:
    """The text of a string item: its own and its rich runs', without phonetic ones."""
    return "".join(t.text or "" for x in item for t in ([x] if x.tag == MAIN + "t" else x.findall(MAIN + "t") if x.tag == MAIN + "r" else []))


def sheet_parts(z: zipfile.ZipFile) -> list[tuple[str, str]]:
    """(name, part) of each sheet in order; without a usable relation the part is found by number."""
    names = set(z.namelist())
    targets = {}
    if "xl/_rels/workbook.xml.rels" in names:
        targets = {r.get("Id"): r.get("Target", "") for r in ET.fromstring(_part(z, "xl/_rels/workbook.xml.rels"))}
    out = []
    for i, s in enumerate(ET.fromstring(_part(z, "xl/workbook.xml")).iter(MAIN + "sheet"), 1):
        target = targets.get(s.get(REL), "")
        path = target.lstrip("/") if target.startswith("/") else posixpath.normpath(f"xl/{target}") if target else ""
        out.append((s.get("name", ""), path if path in names else f"xl/worksheets/sheet{i}.xml"))
    return out


def _value(kind: str, raw: str | None, inline: ET.Element | None, shared: list[str]) -> tuple:
    """(kind, number, text, flag) of a cell."""
    if kind == "inlineStr":
        return ("string", None, _runs(inline) if inline is not None else "", None)
    if raw is None:
        return ("blank", None, None, None)
    if kind == "s":
        i = int(raw)
        return ("string", None, shared[i] if 0 <= i < len(shared) else "", None)
    if kind == "str":
        return ("string", None, raw, None)
    if kind == "e":
        return ("error", None, raw, None)
    if kind == "b":
        return ("boolean", None, None, raw.strip() == "1")
    if kind == "d":
        day = dt.datetime.fromisoformat(raw.strip().replace("Z", ""))
        return ("number", (day - dt.datetime(1899, 12, 30)) / dt.timedelta(days=1), None, None)
    try:
        return ("number", float(raw), None, None)
    except ValueError:
        return ("blank", None, None, None)


def sheet_cells(xml: bytes, shared: list[str]) -> Iterator[tuple]:
    """(row, col, ref, kind, number, text, flag, formula) of each cell with a value or a formula."""
    masters: dict[str, tuple[str, str]] = {}
    table = None
    for event, c in ET.iterparse(io.BytesIO(xml), ("start", "end")):
        if event == "start":
            table = c if c.tag == MAIN + "sheetData" else table
            continue
        if c.tag == MAIN + "row":
            c.clear()
            if table is not None:
                table.clear()  # rows that are done leave nothing behind
        if c.tag != MAIN + "c" or not c.get("r"):
            continue
        ref = c.get("r")
        col, row = split_ref(ref)
        f, v = c.find(MAIN + "f"), c.find(MAIN + "v")
        formula = None
        if f is not None:
            text, group = f.text or "", f.get("si")
            if f.get("t") == "shared" and group is not None:
                if text:
                    masters[group] = (text, ref)
                elif group in masters:
                    text = translate_formula(*masters[group], ref)
            formula = f"={text}" if text else None
        kind, number, text, flag = _value(c.get("t", "n"), v.text if v is not None else None, c.find(MAIN + "is"), shared)
        if kind != "blank" or formula:
            yield row, col, ref, kind, number, text, flag, formula


def parse(data: bytes, workbook: str, only: int | None = None) -> Iterator[tuple]:
    """Rows of CELLS; only: the order number of one sheet."""
    z = _open(data)
    shared = []
    if "xl/sharedStrings.xml" in z.namelist():
        shared = [_runs(x) for x in ET.fromstring(_part(z, "xl/sharedStrings.xml")).iter(MAIN + "si")]
    for i, (name, part) in enumerate(sheet_parts(z)):
        if only is not None and i != only:
            continue
        yield (workbook, name, i, 0, 0, "", "sheet", None, name, None, None)  # a sheet is there also without cells
        if part in z.namelist():
            for row, col, ref, kind, number, text, flag, formula in sheet_cells(_part(z, part), shared):
                yield (workbook, name, i, row, col, ref, kind, number, text, flag, formula)


def plain_path(path: str) -> str:
    """A local path without its scheme; others as they are."""
    return re.sub("^file:/+", "/", path)


#: Cells of a frame: a sheet of any size goes on in frames of this many.
FRAME = 50_000


def frames(rows: Iterator[tuple], columns: list[str]) -> Iterator[pd.DataFrame]:
    """Parsed rows as frames of a bounded size, as they come."""
    for some in batched(rows, FRAME):
        yield pd.DataFrame(some, columns=columns).astype({"v_bool": "boolean", "v_num": "float64"})


def cells_of(files: DataFrame) -> DataFrame:
    """All cells of workbooks given as (path, content). A workbook is named by its whole path; a file that is no workbook fails the query."""

    def run(files):
        names = [x.strip().split(" ")[0] for x in CELLS.split(",")]
        for some in files:
            for name, content in zip(some["path"], some["content"], strict=True):
                yield from frames(parse(bytes(content), plain_path(name)), names)

    return files.select("path", "content").mapInPandas(run, CELLS)


def cells_or_problems(files: DataFrame) -> DataFrame:
    """As `cells_of`, but a file that is no workbook gives one row of kind "problem" that says why, and fails nothing."""

    def run(files):
        names = [x.strip().split(" ")[0] for x in CELLS.split(",")] + ["problem"]
        for some in files:
            for name, content in zip(some["path"], some["content"], strict=True):
                workbook = plain_path(name)
                try:  # a file is taken whole or not at all, so its frames wait for its end
                    made = list(frames(((*r, None) for r in parse(bytes(content), workbook)), names))
                except WorkbookError as e:
                    made = list(frames([(workbook, None, 0, 0, 0, None, "problem", None, None, None, None, str(e))], names))
                yield from made

    return files.select("path", "content").mapInPandas(run, f"{CELLS}, problem string")


def read_cells(spark: SparkSession, path: str) -> DataFrame:
    """All cells of the workbooks at path (a file, a folder or a pattern)."""
    return cells_of(spark.read.format("binaryFile").load(path))


def _cell_xml(ref: str, kind: str, number, text, flag, formula, master: dict, shared: dict) -> str:
    f = ""
    if formula:
        own, column = formula[1:], split_ref(ref)[0]
        # a formula that is a copy of the one above refers to it
        if column in master and translate_formula(master[column][0], master[column][1], ref) == own:
            f = f'<f t="shared" si="{master[column][2]}"/>'
        else:
            master["n"] = master.get("n", -1) + 1
            master[column] = (own, ref, master["n"])
            f = f'<f t="shared" si="{master["n"]}" ref="{ref}">{escape(own)}</f>'
    if kind == "string":
        return f'<c r="{ref}" t="s">{f}<v>{shared.setdefault(text, len(shared))}</v></c>'
    if kind == "boolean":
        return f'<c r="{ref}" t="b">{f}<v>{int(flag)}</v></c>'
    if kind == "error":
        return f'<c r="{ref}" t="e">{f}<v>{escape(text)}</v></c>'
    return f'<c r="{ref}">{f}' + (f"<v>{float(number)!r}</v>" if kind == "number" else "") + "</c>"


def workbook_bytes(sheets: list[tuple[str, list[tuple]]]) -> bytes:
    """A workbook from (sheet, [(row, col, kind, number, text, flag, formula)]); what `parse` reads back."""
    out, shared = io.BytesIO(), {}
    office = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        names = "".join(f'<sheet name={quoteattr(n)} sheetId="{i}" r:id="rId{i}"/>' for i, (n, _) in enumerate(sheets, 1))
        z.writestr("xl/workbook.xml", f'<workbook xmlns="{MAIN[1:-1]}" xmlns:r="{office}"><sheets>{names}</sheets></workbook>')
        links = "".join(f'<Relationship Id="rId{i}" Target="worksheets/sheet{i}.xml"/>' for i in range(1, len(sheets) + 1))
        z.writestr("xl/_rels/workbook.xml.rels", f'<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships">{links}</Relationships>')
        for i, (_, cells) in enumerate(sheets, 1):
            master, rows = {}, {}
            for row, col, *rest in sorted(cells, key=lambda c: c[:2]):
                rows.setdefault(row, []).append(_cell_xml(f"{column_letters(col)}{row}", *rest, master, shared))
            body = "".join(f'<row r="{r}">{"".join(x)}</row>' for r, x in rows.items())
            z.writestr(f"xl/worksheets/sheet{i}.xml", f'<worksheet xmlns="{MAIN[1:-1]}"><sheetData>{body}</sheetData></worksheet>')
        items = "".join(f'<si><t xml:space="preserve">{escape(x)}</t></si>' for x in shared)
        z.writestr("xl/sharedStrings.xml", f'<sst xmlns="{MAIN[1:-1]}">{items}</sst>')
    return out.getvalue()


def to_files(cells: DataFrame) -> DataFrame:
    """Workbooks (path, content) from a table of cells: each workbook is made in one task, as its file format asks."""

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        sheets = []
        for _, own in sorted(frame.groupby("sheet_ord"), key=lambda x: x[0]):
            rows = own[own["kind"] != "sheet"][["row", "col", "kind", "v_num", "v_str", "v_bool", "formula"]]
            sheets.append((own["sheet"].iloc[0], [tuple(None if x is None or x is pd.NA or x != x else x for x in r) for r in rows.itertuples(index=False)]))
        return pd.DataFrame({"path": [frame["workbook"].iloc[0]], "content": [workbook_bytes(sheets)]})

    return cells.groupBy("workbook").applyInPandas(run, "path string, content binary")


class SheetPartition(InputPartition):
    def __init__(self, path: str, sheet: int):
        self.path, self.sheet = path, sheet


class XlsxReader(DataSourceReader):
    def __init__(self, path: str):
        self.path = re.sub("^file:/+", "/", path)

    def partitions(self) -> list[SheetPartition]:
        with open(self.path, "rb") as f:
            return [SheetPartition(self.path, i) for i in range(len(sheet_parts(_open(f.read()))))]

    def read(self, partition: SheetPartition) -> Iterator[tuple]:
        with open(partition.path, "rb") as f:
            yield from parse(f.read(), plain_path(partition.path), partition.sheet)


class XlsxCells(DataSource):
    @classmethod
    def name(cls) -> str:
        return "xlsx_cells"

    def schema(self) -> str:
        return CELLS

    def reader(self, schema) -> XlsxReader:
        return XlsxReader(self.options["path"])


def register(spark: SparkSession) -> None:
    spark.dataSource.register(XlsxCells)
