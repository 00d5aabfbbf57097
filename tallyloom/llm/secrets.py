"""Secret scans: fixed patterns, and sliding-window Shannon entropy over candidate strings.

All in built-in functions. Matches of a pattern get their places from the lengths of the matches and of the text
between them. Candidates are long runs of one character class; a window slides over each, and the entropy in it follows from
counts that change by one character leaving and one entering:

    H = log2(w) - S / w,  S = sum of n * log2(n) over the counts n in the window.

A class has its window and its least entropy. The span found runs from the first to the end of the last window that
reaches it. The allow-list (placeholders, examples, sequences) suppresses the segment of a candidate in which it matches, that is, the signs
up to the next of + / _ = -: no window that holds one of these counts, and the rest of the candidate is judged as ever. Spans inside a
fixed match are left out.

Defined results: a null text counts as empty; an empty text has no spans; a very long text is scanned whole, in one row; places are code points;
repeated rows are scanned each; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass
from math import log2

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import plain, text_of

# The patterns of the contract, in its order of kinds.
ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ASSIGN_MIN = 12
ACCESS = r"AKIA[A-Z0-9]{14,}"
HEX = r"[0-9a-f]{16,}"


@dataclass(frozen=True)
class CharClass:
    """A kind of candidate: its pattern, the alphabet that is counted, the window and the least entropy in bits."""

    kind: str
    pattern: str
    alphabet: str
    window: int
    least: float


_BASE64 = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_-="
_AROUND = r"(?<![A-Za-z0-9+/_=-])", r"(?![A-Za-z0-9+/_=-])"
# A run of base-64 signs must mix lower case, upper case and digits, as keys do and words do not; runs that lack one of the three have classes of
# their own, with longer windows and an entropy that compound words and names in camel case do not reach.
CLASSES = (
    CharClass("entropy_hex", r"(?<![A-Za-z0-9])(?=[0-9A-Fa-f]{24})(?=[A-Fa-f]*[0-9])(?=[0-9]*[A-Fa-f])[0-9A-Fa-f]+(?![A-Za-z0-9])", "0123456789abcdef", 24, 3.0),
    CharClass(
        "entropy_base64",
        _AROUND[0] + r"(?=[A-Za-z0-9+/_=-]{20})(?=[A-Za-z+/_=-]*[0-9])(?=[a-z0-9+/_=-]*[A-Z])(?=[A-Z0-9+/_=-]*[a-z])[A-Za-z0-9+/_=-]+",
        _BASE64,
        20,
        3.9,
    ),
    CharClass("entropy_base32", _AROUND[0] + r"(?=[A-Z2-7]{24})(?=[A-Z]*[2-7])(?=[A-F2-7]*[G-Z])[A-Z2-7]+(?![A-Za-z0-9+/_-])", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567", 24, 3.7),
    CharClass("entropy_lower", _AROUND[0] + r"(?=[a-z0-9]{24})(?=[a-z]*[0-9])(?=[a-f0-9]*[g-z])[a-z0-9]+" + _AROUND[1], "abcdefghijklmnopqrstuvwxyz0123456789", 24, 3.8),
    CharClass("entropy_letters", _AROUND[0] + r"(?=[A-Za-z]{24})(?=[a-z]*[A-Z])(?=[A-Z]*[a-z])[A-Za-z]+" + _AROUND[1], _BASE64[:52], 24, 4.15),
)
ALLOW = (r"(?i:example|sample|placeholder|changeme|dummy|redacted|your[_-]|xxxx|abcdefgh|01234567|12345678)", r"(.)\1{7}")
#: Where a candidate's segments end.
SEGMENT = r"(?<=[+/_=-])"
#: Matches whose places are made at a time.
CHUNK = 128
#: In place of a sign's number in its alphabet.
SUPPRESSED = -2
_SPAN = "array<struct<start:int,rank:int,end:int,kind:string,match:string>>"


def _let(value: Column, body) -> Column:
    """Bind a value once and use it in `body`."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _spans(text: Column, pattern: str, kind: str, rank: int) -> Column:
    """All matches of the pattern, leftmost and apart, with their places."""
    none = F.expr(f"cast(array() as {_SPAN})")

    def placed(m: Column, gaps: Column) -> Column:
        """Places are running sums of the lengths. They are made chunk by chunk, so that appending costs a chunk at most."""
        total = lambda a: F.aggregate(a, F.lit(0), lambda x, y: x + y)
        chunks = F.sequence(F.lit(0), F.floor((F.size(m) - 1) / CHUNK).cast("int"))
        part = lambda a, c: F.slice(a, c * CHUNK + 1, F.lit(CHUNK))
        sizes = F.transform(chunks, lambda c: total(part(gaps, c)) + total(F.transform(part(m, c), lambda x: F.length(x))))
        ends = F.struct(F.lit(0).alias("end"), F.expr("cast(array() as array<int>)").alias("out"))
        bases = F.aggregate(sizes, ends, lambda a, x: F.struct((a["end"] + x).alias("end"), F.concat(a["out"], F.array(a["end"])).alias("out")), lambda a: a["out"])

        def run(base: Column, c: Column) -> Column:
            def add(a: Column, x: Column) -> Column:
                start = a["end"] + F.get(gaps, a["i"])
                end = start + F.length(x)
                span = F.struct(start.alias("start"), F.lit(rank).alias("rank"), end.alias("end"), F.lit(kind).alias("kind"), x.alias("match"))
                return F.struct((a["i"] + 1).alias("i"), end.alias("end"), F.concat(a["out"], F.array(span)).alias("out"))

            return F.aggregate(part(m, c), F.struct((c * CHUNK).alias("i"), base.alias("end"), none.alias("out")), add, lambda a: a["out"])

        return F.flatten(F.transform(bases, run))

    def places(m: Column) -> Column:
        gaps = F.transform(F.split(text, pattern, -1), lambda x: F.length(x))
        return F.when(F.size(m) > 0, _let(gaps, lambda g: placed(m, g))).otherwise(none)

    return _let(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), places)


def _n_log_n(n: Column) -> Column:
    return F.when(n > 1, n * F.log2(n)).otherwise(F.lit(0.0))


def dense(candidate: Column, c: CharClass) -> Column:
    """The first window that reaches the class's entropy and the end of the last, or nulls.

    The state holds the counts of the window and S, and how many signs in a row were not suppressed; a step changes the count of the sign that
    comes and of the one that leaves. A suppressed sign has no count: windows with one are not judged, and it changes nothing when it leaves.
    """
    named = "|".join(f"(?:{p})" for p in ALLOW)
    plain_text = (lambda x: F.lower(x)) if c.kind == "entropy_hex" else (lambda x: x)
    places = lambda x: F.transform(F.filter(F.split(plain_text(x), ""), lambda y: y != ""), lambda y: F.position(y, F.lit(c.alphabet)) - 1)
    signs = F.flatten(F.transform(F.split(candidate, SEGMENT, -1), lambda x: F.when(x.rlike(named), F.array_repeat(F.lit(SUPPRESSED), F.length(x))).otherwise(places(x))))
    limit = c.window * (log2(c.window) - c.least) + 1e-9

    def over(s: Column) -> Column:
        def step(a: Column, i: Column) -> Column:
            def moved(k: Column) -> Column:
                n_in, n_out = F.get(a["counts"], k["came"]), F.get(a["counts"], k["left"])
                gain = F.when(k["came"] >= 0, _n_log_n(n_in + 1) - _n_log_n(n_in)).otherwise(0.0)
                loss = F.when(k["left"] >= 0, _n_log_n(n_out) - _n_log_n(n_out - 1)).otherwise(0.0)
                total = a["s"] + F.when(k["came"] == k["left"], 0.0).otherwise(gain - loss)
                counts = F.transform(a["counts"], lambda v, j: v + F.when(j == k["came"], 1).otherwise(0) - F.when(j == k["left"], 1).otherwise(0))
                return F.struct(counts.alias("counts"), total.alias("s"))

            key = F.struct(F.get(s, i).alias("came"), F.when(i >= c.window, F.get(s, i - c.window)).otherwise(-1).alias("left"))
            state = F.when(key["came"] == key["left"], F.struct(a["counts"].alias("counts"), a["s"].alias("s"))).otherwise(_let(key, moved))

            def seen(n: Column) -> Column:
                sound = F.when(F.get(s, i) >= 0, a["sound"] + 1).otherwise(0)
                hit = (sound >= c.window) & (n["s"] <= limit)
                first = F.when(hit & a["first"].isNull(), i - (c.window - 1)).otherwise(a["first"])
                return F.struct(n["counts"].alias("counts"), n["s"].alias("s"), sound.alias("sound"), first.alias("first"), F.when(hit, i + 1).otherwise(a["last"]).alias("last"))

            return _let(state, seen)

        nothing = F.lit(None).cast("int")
        start = F.struct(F.array_repeat(F.lit(0), len(c.alphabet)).alias("counts"), F.lit(0.0).alias("s"), F.lit(0).alias("sound"), nothing.alias("first"), nothing.alias("last"))
        return F.aggregate(F.sequence(F.lit(0), F.size(s) - 1), start, step, lambda a: F.struct(a["first"].alias("first"), a["last"].alias("last")))

    return _let(signs, over)


def _entropy_spans(text: Column, fixed: Column, c: CharClass, rank: int) -> Column:
    found = _spans(text, c.pattern, c.kind, rank)

    def narrowed(x: Column) -> Column:
        d = dense(x["match"], c)
        return _let(d, lambda w: F.struct((x["start"] + w["first"]).alias("start"), x["rank"].alias("rank"), (x["start"] + w["last"]).alias("end"), x["kind"].alias("kind"), x["match"].alias("match")))

    spans = F.filter(F.transform(found, narrowed), lambda x: x["start"].isNotNull())
    return F.filter(spans, lambda x: ~F.exists(fixed, lambda f: (f["start"] <= x["start"]) & (x["end"] <= f["end"])))


def _joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row for each document: id, n_assign, n_access, n_hex, base (text of the fixed spans), spans (text of all), found.

    found: array of structs (start, rank, end, kind, match), in order.
    """
    own, id_, text = plain(docs, id_col, text_col)
    t = own.select(id_.alias("id"), text_of(text).alias("t"))
    t = t.select(
        "*",
        F.filter(_spans(F.col("t"), ASSIGN, "assign", 0), lambda x: F.length(F.regexp_extract(x["match"], ASSIGN, 2)) >= ASSIGN_MIN).alias("assign"),
        _spans(F.col("t"), ACCESS, "access", 1).alias("access"),
        _spans(F.col("t"), HEX, "hex", 2).alias("hex"),
    )
    t = t.withColumn("fixed", F.sort_array(F.concat("assign", "access", "hex")))
    t = t.select("*", *[_entropy_spans(F.col("t"), F.col("fixed"), c, 3 + i).alias(c.kind) for i, c in enumerate(CLASSES)])
    t = t.withColumn("found", F.sort_array(F.concat("fixed", *[c.kind for c in CLASSES])))
    counts = [F.size(k).cast("bigint").alias(f"n_{k}") for k in ("assign", "access", "hex")]
    return t.select("id", *counts, _joined(F.col("fixed")).alias("base"), _joined(F.col("found")).alias("spans"), "found")
