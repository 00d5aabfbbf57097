"""Where a workbook's five tabs keep their tables: from the first rows of its sheets to rows of a layout, so that the schema of a report is data.

`of_workbook` sees one workbook's head (bounded by the depth of the search and the format's columns) and says which column holds which field of
which block, what the metrics are, what the labels say, and what is missing. Spark calls it once for each workbook (`plans/many.py`).
"""

from __future__ import annotations

import re
from collections.abc import Sequence
from dataclasses import dataclass, field

from ..operators.catalog import EMAIL_RATIOS, P2P_RATIOS, Catalog, accumulated, by_name, by_table, catalog, norm_text, slug_text
from ..operators.discover import Grid
from ..sources.workbook import column_letters, column_number

#: kind: problem (field: its level), finding, tab, meta, source, toggle, definition, period, metric, series, field. A field row says that
#: a column holds `key` of a block: field is what is read (txt, num, flag), num whether the block goes on while it is filled (STOPS).
LAYOUT = "workbook string, tab string, sheet string, kind string, block string, key string, field string, col int, ord int, label string, head int, num double, txt string, numerator string, denominator string"
NAMES = [x.strip().split(" ")[0] for x in LAYOUT.split(",")]
#: A block goes on while one of its stops is filled; while it is a number; while it is filled with other than "Overall".
STOPS = {"txt": 1.0, "num": 2.0, "channel": 3.0}


@dataclass(frozen=True)
class FlatSpec:
    """A tab whose detail rows stand under one header row."""

    name: str
    header: tuple[str, ...]
    dims: dict[str, str]
    required: tuple[str, ...]
    stop: tuple[str, str]
    ratios: dict[str, tuple[str, str]]
    accumulate: tuple[str, ...] | None
    slices: tuple[str, ...]
    month_from_date: bool
    has_ratios: bool = True
    labelled_period: bool = True
    flags: tuple[str, ...] = ()
    last: str = "T"


# Header name -> field, in the order of the sheets.
P2P = FlatSpec(
    "p2p",
    ("topic", "audience"),
    {"client": "client", "year": "year", "quarter": "quarter", "month": "month", "day of week": "day_of_week", "date": "date", "goal": "goal", "topic": "topic", "audience": "audience"},
    ("month", "topic", "audience"),
    ("month", "topic"),
    P2P_RATIOS,
    ("gross_spend", "immediate_raised", "donors"),
    ("audience", "topic"),
    False,
)
EMAIL = FlatSpec(
    "email",
    ("audience", "mailing topic"),
    {
        "year": "year", "quarter": "quarter", "month": "month_num", "day of week": "day_of_week", "date": "date", "send time (et)": "send_time", "ask": "ask", "subtype": "subtype",
        "mailing topic": "topic", "sender": "sender", "subject line": "subject_line", "audience": "audience", "label": "label",
    },
    ("date", "topic", "audience", "label"),
    ("label", "date"),
    EMAIL_RATIOS,
    ("raised", "recipients", "donors"),
    ("audience", "topic"),
    True,
)
HIGH_DOLLAR = FlatSpec(
    "high_dollar",
    ("receipt_id", "amount"),
    {
        "category": "category", "receipt_id": "receipt_id", "date": "date", "fundraising_page": "fundraising_page", "first": "first", "last": "last", "email": "email",
        "finance claim": "finance_claim", "authentic added": "authentic_added",
    },
    ("receipt_id", "date"),
    ("receipt_id", "date"),
    {},
    None,
    ("category",),
    True,
    has_ratios=False,
    labelled_period=False,
    flags=("finance_claim", "authentic_added"),
)
FLAT = {s.name: s for s in (P2P, EMAIL, HIGH_DOLLAR)}
NUMBERS = ("year", "quarter", "month_num", "date")


@dataclass(frozen=True)
class TabSpec:
    name: str
    title: str
    pattern: str


# The tabs' names and patterns.
TABS = (
    TabSpec("digital", "Digital Report", "^digital report$"),
    TabSpec("paid", "Paid Media Report", "^paid media report$"),
    TabSpec("p2p", "P2P Statistics", "^p2p statistics$"),
    TabSpec("email", "Email Statistics", "^email statistics$"),
    TabSpec("high_dollar", "High-Dollar Donations", "^high[- ]dollar donations$"),
)
TITLES = {t.name: t.title for t in TABS}
# Import tabs that formulas name, in order of preference.
SOURCES = ("Import - Quarterly Goals", "Quarterly Fundraising Toplines", "Import - Monthly Goals", "Monthly Fundraising Toplines")


@dataclass
class Draft:
    """The layout rows of one tab as they are found."""

    workbook: str
    tab: str
    sheet: str | None = None
    rows: list[dict] = field(default_factory=list)
    failed: bool = False

    def add(self, kind: str, **what) -> None:
        self.rows.append({"kind": kind, "ord": len(self.rows), **what})

    def error(self, text: str) -> None:
        self.failed = True
        self.add("problem", field="error", txt=text)

    def warn(self, text: str) -> None:
        self.add("problem", field="warn", txt=text)

    def found(self, text: str) -> None:
        self.add("finding", txt=text)

    def put(self, block: str, head: int, key: str, what: str, col: int, stop: str | None = None, label: str | None = None) -> None:
        """A field of a block; of two columns for one field the first stays."""
        if not any(r["kind"] == "field" and r["block"] == block and r["key"] == key for r in self.rows):
            self.add("field", block=block, head=head, key=key, field=what, col=col, num=STOPS[stop] if stop else 0.0, label=label)

    def catalog(self, cat: Catalog) -> None:
        for m in cat.metrics:
            self.add("metric", key=m.key, label=m.label, field=m.kind, col=column_number(m.column), numerator=m.numerator, denominator=m.denominator)

    def done(self) -> list[tuple]:
        fixed = {"workbook": self.workbook, "tab": self.tab, "sheet": self.sheet}
        return [tuple({**dict.fromkeys(NAMES), **r, **fixed}[n] for n in NAMES) for r in self.rows]


def pick_sheet(names: Sequence[str], spec: TabSpec, out: Draft) -> str | None:
    """The sheet of the tab's name, else the only one that has all its words, with a warning."""
    exact = [n for n in names if re.search(spec.pattern, norm_text(n))]
    if exact:
        return exact[0]
    loose = [n for n in names if all(w in norm_text(n) for w in spec.title.lower().split(" "))]
    if len(loose) == 1:
        out.warn(f"“{loose[0]}” is read as “{spec.title}”.")
        return loose[0]
    out.error(f"The workbook has no “{spec.title}”, only: {', '.join(names)}.")
    return None


class Columns:
    """Of each column of a sheet, the last row that is filled and the last that is filled with no number."""

    def __init__(self, filled: dict[int, int], worded: dict[int, int]):
        self.filled, self.worded = filled, worded

    def numeric(self, col: int, below: int) -> bool:
        """Every filled cell below a row is a number, and there is one."""
        return self.filled.get(col, 0) > below >= self.worded.get(col, 0)


def of_workbook(workbook: str, sheets: list[tuple[str, Grid, Columns]]) -> list[tuple]:
    """Layout rows of all tabs; sheets in their order."""
    by_name_ = {n: (g, c) for n, g, c in reversed(sheets)}
    out = []
    for spec in TABS:
        draft = Draft(workbook, spec.name)
        draft.sheet = pick_sheet([n for n, _, _ in sheets], spec, draft)
        draft.add("tab", num=float(len(sheets)))
        if draft.sheet is not None:
            grid, columns = by_name_[draft.sheet]
            if spec.name == "digital":
                digital(draft, grid)
            elif spec.name == "paid":
                paid(draft, grid)
            else:
                flat(draft, grid, columns, FLAT[spec.name])
        out += draft.done()
    return out


def flat(out: Draft, grid: Grid, columns: Columns, spec: FlatSpec) -> None:
    row = grid.header_row(spec.header)
    if not row:
        out.error("No header row names " + " and ".join(f"“{h}”" for h in spec.header) + ": the tab is not read.")
        return
    out.found(f"The header is row {row}.")
    heads = grid.headers(row, "A", max(grid.max_col, column_number(spec.last)))
    dims = {spec.dims[h.key]: h.col for h in heads if h.key in spec.dims}
    for need in spec.required:
        if need not in dims:
            out.error(f"Row {row} lacks the column “{need}”.")
    if out.failed:
        return
    others = [h for h in heads if h.key not in spec.dims and not h.key.startswith("helper")]
    texts = [h for h in others if not columns.numeric(h.col, row)]
    if texts:
        out.found("No metrics, as they hold text: " + ", ".join(f"{h.letters} “{h.label}”" for h in texts) + ".")
    metrics = [h for h in others if columns.numeric(h.col, row)]
    if not metrics:
        out.error(f"Row {row} heads no column of numbers.")
        return
    cat = catalog([(h.label, h.letters) for h in metrics], by_table(spec.ratios), spec.has_ratios)
    out.catalog(cat)
    if missing := [m.label for m in cat.ratios if m.unresolvable and spec.has_ratios]:
        out.warn("Components unknown, so blank in every rollup: " + ", ".join(missing) + ".")
    if not any(grid.text(row + 1, dims[s]) is not None for s in spec.stop):
        out.error(f"Nothing stands below the header in row {row}.")
        return
    for name, col in dims.items():
        what = "num" if name in NUMBERS else "flag" if name in spec.flags else "txt"
        out.put("detail", row, f"d:{name}", what, col, "txt" if name in spec.stop else None)
    for m in cat.metrics:
        out.put("detail", row, f"m:{m.key}", "num", column_number(m.column))
    wanted = list(spec.accumulate) if spec.accumulate else cat.keys()
    for key in accumulated(cat, wanted)[0]:
        out.add("series", key=key)
    if spec.labelled_period:
        for key in ("year", "quarter"):
            at = grid.labelled("A", "B", f"^{key}$")
            out.add("meta", key=key, field="num", num=at and at["num"])
            if not at or at["num"] is None:
                out.warn(f"The {key} of the report is not given.")


def digital(out: Draft, grid: Grid) -> None:
    top = grid.find_row("B", "^quarterly toplines$")
    if not top:
        out.error("Column B has no heading “Quarterly Toplines”: the tab is not read.")
        return
    head = top + 1
    last = max(grid.max_col, 20)
    text = {c: norm_text(grid.text(head, c)) for c in range(1, last + 3)}
    groups = [(c, grid.text(top, c)) for c in range(2, last + 1) if text[c] == "goal" and text[c + 1] == "actual" and text[c + 2].startswith("%")]
    if not groups:
        out.error(f"Row {head} has no three columns for goal, actual and percent: the tab is not read.")
        return
    named = [(c, label) for c, label in groups[1:] if label]
    if len(named) < len(groups) - 1:
        out.warn(f"Columns without a month in row {top} are left out.")
    if not named:
        out.error("Only the quarter has columns; the months are missing.")
    months = {slug_text(label): label for _, label in named}
    periods = [("quarter", 0, "Quarter", groups[0][0])] + [(slug_text(label), i + 1, label.strip(), c) for i, (c, label) in enumerate(named)]
    overall = grid.find_row("B", "^overall$")
    if not overall:
        out.error("Column B has no “Overall”.")
    first = grid.text(head + 1, "B")
    if first is None or norm_text(first) == "overall":
        out.error("No channel stands below the header.")
        return
    for block, at in (("channel", head), ("overall", overall)):
        if at:
            out.put(block, at, "d:channel", "txt", 2, "channel" if block == "channel" else "txt")
            for key, _, _, c in periods:
                for i, f in enumerate(("goal", "actual", "pct")):
                    out.put(block, at, f"p:{key}:{f}", "num", c + i)
    seen: set[str] = set()
    for key, order, label, c in periods:
        if key not in seen:
            out.add("period", key=key, num=float(order), label=label, col=c)
        seen.add(key)
    formula = {f"{key}_{f}": (grid.grid.get((head + 1, c + i)) or {"formula": None})["formula"] for key, _, _, c in periods for i, f in enumerate(("goal", "actual"))}
    _helpers(out, head, formula["quarter_goal"], list(months))
    toggles = _toggles(grid, head, months)
    for key, (cell, value) in toggles.items():
        out.add("toggle", key=key, label=cell, num=float(value))
    if any(v for _, v in toggles.values()):
        out.warn("Dynamic goals are on for " + ", ".join(k for k, (_, v) in toggles.items() if v) + ": the quarter's goal counts actuals there.")
    for key, pattern, what in (("client", "^client$", "txt"), ("lead", "^email lead$", "txt"), ("year", "^year$", "num"), ("quarter", "^quarter$", "num")):
        at = grid.labelled("B", "C", pattern) or {"text": None, "num": None}
        out.add("meta", key=key, field=what, **({"num": at["num"]} if what == "num" else {"txt": at["text"]}))
        if what == "num" and at["num"] is None:
            out.warn(f"The {key} of the report is not given.")
    title = grid.find_row("B", "toplines$", top - 1)
    out.add("meta", key="title", field="txt", txt=grid.text(title, "B") if title and title < top else None)
    for key, f in formula.items():
        hit = next((s for s in SOURCES if s in (f or "")), None)
        if hit:
            out.add("source", key=key, txt=hit)


def _toggles(grid: Grid, head: int, months: dict[str, str]) -> dict[str, tuple]:
    """Flags beside a month's name above the month headers (which themselves do not count)."""
    out = {}
    for key, label in months.items():
        at = sorted((c, r) for (r, c), cell in grid.grid.items() if c >= 2 and r < head - 1 and norm_text(cell["txt"]) == norm_text(label))
        hit = next(((r, c + 1) for c, r in at if (r, c + 1) in grid.grid), None)
        out[key] = (f"{column_letters(hit[1])}{hit[0]}", bool(grid.grid[hit]["flag"])) if hit else (None, False)
    return out


def _helpers(out: Draft, head: int, formula: str | None, months: list[str]) -> None:
    """Hidden helper columns behind the quarterly goal's SUM, one for each month by position."""
    m = re.match(r"=\s*SUM\(\s*\$?([A-Z]+)\$?\d+\s*:\s*\$?([A-Z]+)\$?\d+\s*\)", formula or "", re.IGNORECASE)
    if not m:
        out.warn("The quarter's goal is no sum of columns, so there are no helpers.")
        return
    cols = list(range(column_number(m[1].upper()), column_number(m[2].upper()) + 1))
    if len(cols) != len(months):
        out.warn(f"{len(cols)} helper columns stand against {len(months)} months; they are matched in order.")
    for key, col in zip(months, cols, strict=False):
        out.put("channel", head, f"h:{key}", "num", col)
    out.found("Helper columns: " + ", ".join(column_letters(c) for c in cols) + ".")


def paid(out: Draft, grid: Grid) -> None:
    rows = {"quarterly": grid.find_row("B", "^quarterly toplines$"), "monthly": grid.find_row("B", "^monthly toplines$"), "detail": grid.find_row("B", "^month$")}
    if not all(rows.values()):
        out.error("Column B lacks the heading of: " + ", ".join(k for k, r in rows.items() if not r) + ". The tab is not read.")
        return
    out.found("Tables begin at " + ", ".join(f"B{r} ({k})" for k, r in rows.items()) + ".")
    last = max(grid.max_col, column_number("N"))
    own = [h for h in grid.headers(rows["detail"], "F", last) if not h.key.startswith("helper")]
    if not own:
        out.error(f"Row {rows['detail']} heads no metric.")
        return
    cat = catalog([(h.label, h.letters) for h in own], by_name)
    out.catalog(cat)
    side = {k: {h.key: h.col for h in grid.headers(row, "B", "E")} for k, row in rows.items()}
    dims = {
        "quarterly": {"quarter": (side["quarterly"].get("quarter", 5), "num")},
        "monthly": {"label": (side["monthly"].get("month", 5), "txt")},
        "detail": {
            "month": (side["detail"].get("month", 2), "txt"),
            "channel": (side["detail"].get("channel", 3), "txt"),
            "placement": (side["detail"].get("placement", 4), "txt"),
            "objective": (side["detail"].get("goal", side["detail"].get("objective", 5)), "txt"),
        },
    }
    for k, row in rows.items():
        there = {h.key: h.col for h in grid.headers(row, "F", last)}
        # each block is read by its own header; a metric that it lacks by the detail's column
        cols = {m.key: there.get(norm_text(m.label), column_number(m.column)) for m in cat.metrics}
        if moved := [m.label for m in cat.metrics if cols[m.key] != column_number(m.column)]:
            out.warn(f"Columns of the {k} table differ from the detail's for {', '.join(moved)}; each table goes by its header.")
        first, what = next(iter(dims[k].values()))
        cell = grid.grid.get((row + 1, first))
        if cell is None or cell["txt" if what == "txt" else "num"] is None:
            out.error(f"The {k} table at B{row} is empty.")
        for i, (name, (col, kind)) in enumerate(dims[k].items()):
            out.put(k, row, f"d:{name}", kind, col, kind if i == 0 else None)
        for key, col in cols.items():
            out.put(k, row, f"m:{key}", "num", col)
    if out.failed:
        return
    if lost := [m.label for m in cat.ratios if m.unresolvable]:
        out.warn("Components unknown, so blank for the year: " + ", ".join(lost) + ".")
    keys, text = accumulated(cat, ["gross_spend", "ntl", "total_raised"], fallback=True)
    for key in keys:
        out.add("series", key=key)
    if text:
        out.warn(text)
    n = 0
    for row in range(1, rows["quarterly"]):
        # terms that end in a colon with prose to their right, above the first table; the first of a row
        for col in range(column_number("F"), column_number("H") + 1):
            term, prose = grid.text(row, col), grid.text(row, col + 1)
            if term and prose and term.endswith(":") and len(prose) > 12:
                out.add("definition", key=term[:-1], txt=prose, label=f"{column_letters(col)}{row}", field=f"{column_letters(col + 1)}{row}")
                n += 1
                break
    if not n:
        out.warn("The sheet defines no terms.")
    for key, pattern, what in (("year", "^year$", "num"), ("quarter", "^quarter$", "num"), ("client", "^client$", "txt"), ("lead", "^paid media lead$", "txt")):
        at = grid.labelled("B", "C", pattern) or {"text": None, "num": None}
        out.add("meta", key=key, field=what, **({"num": at["num"]} if what == "num" else {"txt": at["text"]}))
    out.add("meta", key="title", field="txt", txt=grid.text(grid.find_row("B", "paid media report") or 2, "B"))
    quarter = grid.labelled("B", "C", "^quarter$")
    if not quarter or quarter["num"] is None:
        out.warn("The quarter of the report is not given.")
