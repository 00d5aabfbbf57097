"""Scalar semantics of workbook cells and reported metrics, as Spark column expressions only."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Deepest row searched for a heading.
MAX_SCAN = 200
#: Cells that a flag names; the rest is a number.
MAX_CELLS = 6

# The ordered rules that tell a metric's kind by its normalised header. Else it is money.
KIND_RULES = (
    ("roas", r"roas"),
    ("rate", r"rate$"),
    ("usd2", r"cpa|cost per|average"),
    ("count", r"^ntl$|names|count|recipients|donors|unsubs?$|actions?$"),
)
DEFAULT_KIND = "usd"
ADDITIVE_KINDS = ("usd", "count")


def _c(value) -> Column:
    return F.col(value) if isinstance(value, str) else value


# --- text ---------------------------------------------------------------------------------------------------------


def norm(text) -> Column:
    """Lower case, white space (of any script) as single spaces, trimmed, without one closing colon; null is empty."""
    one = F.regexp_replace(F.coalesce(_c(text), F.lit("")), r"(?U)\s+", " ")
    return F.regexp_replace(F.lower(F.trim(one)), ":$", "")


def slug(text) -> Column:
    return F.regexp_replace(F.regexp_replace(norm(text), "[^a-z0-9]+", "_"), "^_|_$", "")


def number_text(value) -> Column:
    """A number as a cell shows it: 7, not 7.0."""
    v = _c(value)
    whole = (v == F.floor(v)) & (F.abs(v) < 1e15)
    return F.when(whole, F.floor(v).cast("bigint").cast("string")).otherwise(v.cast("string"))


def short_number(value) -> Column:
    """Two decimals from 1 on; below, six without closing zeros; a dash for null."""
    v = _c(value)
    small = F.regexp_replace(F.regexp_replace(F.format_string("%.6f", v), "0+$", ""), r"\.$", "")
    return F.when(v.isNull(), "—").when(F.abs(v) >= 1, F.format_string("%.2f", v)).otherwise(small)


def bad_cell(ref, stored, expected) -> Column:
    return F.concat(F.coalesce(_c(ref), F.lit("?")), F.lit(" shows "), short_number(stored), F.lit(", components give "), short_number(expected))


# --- cells --------------------------------------------------------------------------------------------------------


def cell_text(kind="kind", text="v_str", number="v_num", flag="v_bool") -> Column:
    """A cell's trimmed text; blank is null."""
    shown = F.when(_c(kind) == "number", number_text(number)).when(_c(kind) == "boolean", _c(flag).cast("string")).otherwise(_c(text))
    return F.nullif(F.regexp_replace(shown, r"(?U)^\s+|\s+$", ""), F.lit(""))


def lenient_number(text) -> Column:
    """The number that a text begins with, after signs of money, thousands and percent went; '-', '#...' and blanks are null."""
    bare = F.regexp_replace(F.regexp_replace(F.trim(_c(text)), "[,$%]", ""), r"(?U)^\s+", "")
    head = F.regexp_extract(bare, r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?", 0)
    return F.nullif(head, F.lit("")).try_cast("double")


def cell_number(kind="kind", text="v_str", number="v_num") -> Column:
    return F.when(_c(kind) == "number", _c(number)).when(_c(kind) == "string", lenient_number(text))


def cell_flag(kind="kind", text="v_str", number="v_num", flag="v_bool") -> Column:
    """Never null: only a true flag, a number other than 0, or the text TRUE."""
    said = F.when(_c(kind) == "boolean", _c(flag)).when(_c(kind) == "number", _c(number) != 0).otherwise(F.upper(F.trim(_c(text))) == "TRUE")
    return F.coalesce(said, F.lit(False))


def strict_number(text) -> Column:
    """An auditor's number: the whole text after signs of money and thousands went."""
    return F.regexp_replace(F.trim(_c(text)), "[,$]", "").try_cast("double")


def shown_number(text) -> Column:
    """A displayed figure's digits, point and sign."""
    return F.nullif(F.regexp_replace(_c(text), r"[^0-9.\-]", ""), F.lit("")).try_cast("double")


def column_number(letters) -> Column:
    """A -> 1, Z -> 26, AA -> 27."""
    signs = F.filter(F.split(_c(letters), ""), lambda x: x != "")
    return F.aggregate(signs, F.lit(0), lambda n, x: n * 26 + F.ascii(x) - 64)


def column_letters(n) -> Column:
    """1 -> A, up to three letters."""
    v = _c(n).cast("int")
    letter = lambda x: F.char(F.lit(65) + x.cast("int") % 26)
    third = F.when(v > 702, letter(F.floor((v - 703) / 676))).otherwise("")
    second = F.when(v > 26, letter(F.floor((v - 27) / 26))).otherwise("")
    return F.concat(third, second, letter(v - 1))


def cell_column(ref) -> Column:
    return F.nullif(F.regexp_extract(_c(ref), r"^([A-Z]+)(\d+)$", 1), F.lit(""))


def cell_row(ref) -> Column:
    return F.nullif(F.regexp_extract(_c(ref), r"^([A-Z]+)(\d+)$", 2), F.lit("")).cast("int")


# --- dates --------------------------------------------------------------------------------------------------------


def serial_date(serial) -> Column:
    """A spreadsheet's day number as a date (UTC, 1900 system; days 1 to 59 come a day early)."""
    ms = F.floor((_c(serial) - 25569) * 86_400_000 + 0.5).cast("bigint")
    return F.timestamp_millis(ms).cast("date")


def date_serial(day) -> Column:
    return (F.unix_date(_c(day).cast("date")) + 25569).cast("double")


def month_label(day) -> Column:
    return F.date_format(_c(day), "MMMM yyyy")


def quarter_label(n) -> Column:
    return F.concat(F.lit("Q"), F.floor(_c(n) + 0.5).cast("int").cast("string"))


# --- metrics ------------------------------------------------------------------------------------------------------


def metric_kind(label) -> Column:
    n = norm(label)
    out = None
    for kind, rule in KIND_RULES:
        out = F.when(n.rlike(rule), kind) if out is None else out.when(n.rlike(rule), kind)
    return out.otherwise(DEFAULT_KIND)


def is_additive(kind) -> Column:
    return _c(kind).isin(*ADDITIVE_KINDS)


def truthy(value) -> Column:
    return F.coalesce(_c(value), F.lit(0.0)) != 0


def ratio(numerator, denominator) -> Column:
    """null under a null or zero denominator; a null numerator counts as 0."""
    return F.when(truthy(denominator), F.coalesce(_c(numerator), F.lit(0.0)) / _c(denominator))


def near(a, b, tolerance=0.02) -> Column:
    return F.coalesce(F.abs(_c(a) - _c(b)) <= tolerance, F.lit(False))


def close(a, b, tolerance=0.02) -> Column:
    """Like near, and two nulls agree."""
    return (_c(a).isNull() & _c(b).isNull()) | near(a, b, tolerance)


def money(value) -> Column:
    """Exact cents, so that sums do not depend on their order."""
    return _c(value).cast("decimal(18,2)")


def exact_sum(value, kind: str = DEFAULT_KIND) -> Column:
    """A sum that does not depend on its order: of cents, or of millionths for counts. Null if all values are null."""
    return F.sum(_c(value).cast("decimal(24,6)" if kind == "count" else "decimal(28,2)")).cast("double")
