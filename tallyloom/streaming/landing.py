"""A stream from a landing folder of workbooks to a table of cells.

Each new file is parsed once, in a task; the sink's log makes its cells appear once. A later version of a workbook comes as a file of its own, and
`latest` keeps the newest of each name in whichever folder (`by="path"`: of each whole path).
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..functions.semantics import MAX_SCAN
from ..operators.discover import BELOW, Grid
from ..plans.layout import NAMES, Columns, of_workbook
from ..sources.workbook import CELLS, WorkbookError, parse, plain_path
from ..sources.workbook import frames as cell_frames

FILES = "path string, modificationTime timestamp, length bigint, content binary"
ARRIVED = f"{CELLS}, arrived timestamp, problem string"


def arriving(spark: SparkSession, folder: str, files_per_batch: int = 100) -> DataFrame:
    """The stream of cells; a file that is no workbook gives one row with its problem."""
    names = [x.strip().split(" ")[0] for x in ARRIVED.split(",")]

    def run(frames):
        for frame in frames:
            for path, at, content in zip(frame["path"], frame["modificationTime"], frame["content"], strict=True):
                name = plain_path(path)
                made = []  # a file is taken whole or not at all, so its frames wait for its end
                try:
                    made = list(cell_frames(((*r, at, None) for r in parse(bytes(content), name)), names))
                except WorkbookError as e:
                    made = list(cell_frames([(name, None, 0, 0, 0, None, "problem", None, None, None, None, at, str(e))], names))
                yield from made

    files = spark.readStream.format("binaryFile").schema(FILES).option("maxFilesPerTrigger", files_per_batch).option("pathGlobFilter", "*.xlsx").load(folder)
    return files.select("path", "modificationTime", "content").mapInPandas(run, ARRIVED)


def ingest(spark: SparkSession, folder: str, table: str, checkpoint: str, **trigger) -> StreamingQuery:
    """Append arriving cells to a Parquet table; trigger: as of writeStream.trigger (default: what is there now)."""
    out = arriving(spark, folder).writeStream.format("parquet").option("path", table).option("checkpointLocation", checkpoint)
    return out.trigger(**(trigger or {"availableNow": True})).start()


def latest(cells: DataFrame, by: str = "name") -> DataFrame:
    """The cells of the newest arrival of each workbook that could be read. by="name": versions are files of one name; of equally new ones the last path counts."""
    good = cells.where("problem IS NULL").withColumn("__of", F.regexp_extract("workbook", "[^/]*$", 0) if by == "name" else F.col("workbook"))
    newest = good.groupBy("__of").agg(F.max(F.struct("arrived", "workbook")).alias("__last"))
    return good.join(newest, "__of").where("workbook = __last.workbook AND arrived = __last.arrived").select(*[F.col(x.strip().split(" ")[0]) for x in CELLS.split(",")])


STATE = "path string, arrived timestamp"
DECIDED = "name string, path string, arrived timestamp, accepted boolean, reason string, current string"


def judge(path: str, content: bytes) -> str | None:
    """Why a workbook is refused: it cannot be read, or none of its tabs can. Other faults are problems of a report, not of a load."""
    try:
        cells = list(parse(content, path))
    except WorkbookError as e:
        return str(e)
    sheets: dict[int, tuple[str, dict, dict, dict]] = {}
    for _, sheet, order, row, col, _, kind, number, text, flag, formula in cells:
        _, grid, filled, worded = sheets.setdefault(order, (sheet, {}, {}, {}))
        if kind == "sheet":
            continue
        shown = text if kind in ("string", "error") else None if number is None and flag is None else str(number if number is not None else flag)
        shown = (shown or "").strip() or None
        value = number if kind == "number" else _number(shown) if kind == "string" else None
        if shown is not None:
            filled[col] = max(filled.get(col, 0), row)
            if value is None:
                worded[col] = max(worded.get(col, 0), row)
        if row <= MAX_SCAN + BELOW and (shown is not None or formula):
            grid[row, col] = {"row": row, "col": col, "txt": shown, "num": value, "flag": bool(flag), "formula": formula}
    laid = of_workbook(path, [(name, Grid(name, grid), Columns(filled, worded)) for _, (name, grid, filled, worded) in sorted(sheets.items())])
    errors: dict[str, list[str]] = {}
    for r in laid:
        named = dict(zip(NAMES, r, strict=True))
        errors.setdefault(named["tab"], [])
        if named["kind"] == "problem" and named["field"] == "error":
            errors[named["tab"]].append(named["txt"])
    return None if any(not e for e in errors.values()) else "; ".join(x for e in errors.values() for x in e)


def _number(text: str | None) -> float | None:
    try:
        return float((text or "").replace(",", "").replace("$", "").replace("%", ""))
    except ValueError:
        return None


def decisions(files: DataFrame) -> DataFrame:
    """A stream of DECIDED: each arriving version of a workbook is accepted or refused, and `current` is the version that counts from then on.

    files: a stream of (path, modificationTime, content). The state holds the last good version of each name, so a broken one changes
    nothing, in this batch or a later one; of versions in one batch the order of arrival counts, and one older than the current is refused.
    """

    def run(key, frames, state: GroupState):
        last = state.get if state.exists else (None, None)
        rows = []
        every = pd.concat(list(frames)).sort_values(["modificationTime", "path"])
        for path, at, content in zip(every["path"], every["modificationTime"], every["content"], strict=True):
            reason = judge(plain_path(path), bytes(content))
            if reason is None and last[1] is not None and at < last[1]:
                reason = "a newer version counts already"
            if reason is None:
                last = (plain_path(path), at)
            rows.append((key[0], plain_path(path), at, reason is None, reason, last[0]))
        if last[0] is not None:
            state.update(last)
        yield pd.DataFrame(rows, columns=[x.strip().split(" ")[0] for x in DECIDED.split(",")])

    named = files.select("path", "modificationTime", "content", F.regexp_extract("path", "[^/]*$", 0).alias("name"))
    return named.groupBy("name").applyInPandasWithState(run, DECIDED, STATE, "append", GroupStateTimeout.NoTimeout)


def reload(spark: SparkSession, folder: str, table: str, checkpoint: str, files_per_batch: int = 100, **trigger) -> StreamingQuery:
    """Append the decisions on arriving workbooks to a Parquet table."""
    files = spark.readStream.format("binaryFile").schema(FILES).option("maxFilesPerTrigger", files_per_batch).option("pathGlobFilter", "*.xlsx").load(folder)
    out = decisions(files).writeStream.format("parquet").option("path", table).option("checkpointLocation", checkpoint)
    return out.trigger(**(trigger or {"availableNow": True})).start()


def standing(cells: DataFrame, decided: DataFrame) -> DataFrame:
    """The cells of the version of each workbook that counts: its last accepted one."""
    last = decided.where("accepted").groupBy("name").agg(F.max(F.struct("arrived", "path")).alias("last")).select(F.col("last.path").alias("workbook"))
    return cells.join(last, "workbook", "left_semi")
