import json
import os
import struct
import zipfile

import pytest

from tallyloom.plans.report import Refused, build, load
from tallyloom.sources.snapshots import read_snapshot
from tallyloom.sources.workbook import WorkbookError, parse, read_cells, register, translate_formula

from . import workbooks as wb


@pytest.fixture(scope="module")
def path(tmp_path_factory):
    p = tmp_path_factory.mktemp("wb") / "report.xlsx"
    p.write_bytes(wb.workbook(wb.everything()))
    return str(p)


@pytest.fixture(scope="module")
def report(spark, path):
    return load(spark, path)


def cells_of(spark, sheets):
    from tallyloom.sources.workbook import CELLS

    return spark.createDataFrame(list(parse(wb.workbook(sheets), "x.xlsx")), CELLS)


def test_translate_formula():
    t = translate_formula
    assert t("A1+$B$2*C$3", "D4", "E6") == "B3+$B$2*D$3"
    assert t('"A1"&A1&LOG10(B2)', "A1", "B2") == '"A1"&B2&LOG10(C3)'
    assert t("'My A1'!A1+Sheet2!Z9", "A1", "B1") == "'My A1'!B1+Sheet2!AA9"
    assert t("A1", "C3", "A1") == "A1"  # not above or left of the sheet


def test_cells_of_all_kinds(spark, tmp_path):
    ns = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"
    shared = f'<sst xmlns="{ns}"><si><t>plain</t></si><si><r><t>ri</t></r><r><t>ch &amp; </t></r><rPh><t>x</t></rPh></si></sst>'
    body = (
        '<row r="1"><c r="A1" t="s"><v>0</v></c><c r="B1" t="s"><v>1</v></c><c r="C1" t="str"><f>A1</f><v>s</v></c><c r="D1" t="e"><v>#REF!</v></c><c r="E1" t="b"><v>1</v></c></row>'
        '<row r="2"><c r="A2"><f t="shared" si="0" ref="A2:A3">B2*$C$1</f><v>1.5</v></c><c r="B2" t="d"><v>2026-08-03</v></c><c r="C2"/><c r="AA2" t="inlineStr"><is><t>in</t></is></c></row>'
        '<row r="3"><c r="A3"><f t="shared" si="0"/><v>2</v></c></row>'
    )
    p = tmp_path / "k.xlsx"
    p.write_bytes(wb.workbook({"One": body, "Empty": ""}, {"xl/sharedStrings.xml": shared}))
    got = {r["ref"]: r for r in read_cells(spark, str(p)).where("kind <> 'sheet'").collect()}
    assert got["B1"]["v_str"] == "rich & " and got["C1"]["formula"] == "=A1" and got["D1"]["kind"] == "error" and got["E1"]["v_bool"] is True
    assert got["A3"]["formula"] == "=B3*$C$1" and got["A2"]["v_num"] == 1.5 and got["B2"]["v_num"] == 46237 and got["AA2"]["col"] == 27 and "C2" not in got
    register(spark)
    other = spark.read.format("xlsx_cells").load(str(p))
    assert other.rdd.getNumPartitions() == 2
    assert sorted(map(str, other.collect())) == sorted(map(str, read_cells(spark, str(p)).collect()))


def test_rejections():
    good = wb.workbook({"S": {"A1": 1}})
    with pytest.raises(WorkbookError, match="not an .xlsx"):
        list(parse(b"a,b\n1,2", "x"))
    with pytest.raises(WorkbookError, match="directory"):
        list(parse(b"PK" + bytes(100), "x"))
    with pytest.raises(WorkbookError, match="encrypted"):
        list(parse(wb.workbook({"S": {}}, {"EncryptedPackage": "x"}), "x"))
    with pytest.raises(WorkbookError, match="ZIP64"):
        list(parse(good + b"PK\x06\x07" + bytes(16), "x"))
    with pytest.raises(WorkbookError, match="cannot be read"):
        list(parse(b"PKXX" + good[4:], "x"))  # a bad local header
    central = good.index(b"PK\x01\x02")
    with pytest.raises(WorkbookError, match="unknown compression"):
        list(parse(good[: central + 10] + struct.pack("<H", 12) + good[central + 12 :], "x"))
    import io

    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("other.xml", "x")
    with pytest.raises(WorkbookError, match="no workbook part"):
        list(parse(out.getvalue(), "x"))


def test_digital(report):
    t = report.tabs["digital"]
    assert t.problems == [] and t.meta["client"] == "Acme" and t.meta["year"] == 2026 and t.meta["title"] == "Fundraising Toplines"
    rows = {(r["channel"], r["period_key"]): r for r in t.tables["channel_period"].where("block = 'channel'").collect()}
    assert len(rows) == 8 * 4 and rows["Channel 2", "august"]["goal"] == 3100 and rows["Channel 2", "august"]["pct_cell"] == "L16"
    assert t.tables["helpers"].count() == 24 and t.tables["helpers"].where("period_key = 'august' AND row = 16").first()["value"] == 3100
    s = t.tables["series"].where("channel = 'Channel 2' AND period_key = 'september'").first()
    assert s["cum_goal"] == 9300 and s["goal_cells"] == ["G16", "J16", "M16"] and not s["pending"]


def test_digital_growth_and_pending(spark):
    r = build(spark, cells_of(spark, {**wb.everything(), "Digital Report": wb.digital(11, unreported=1)}), "x")
    t = r.tabs["digital"]
    assert not t.failed and len(t.lists["channels"]) == 11 and t.lists["pending"] == ["september"]
    s = t.tables["series"].where("channel = 'Channel 10'").orderBy("period_ord").collect()
    assert [x["pending"] for x in s] == [False, False, True] and s[2]["cum_actual"] is None and s[2]["cum_goal"] is not None


def test_paid(report):
    t = report.tabs["paid"]
    _, detail = wb.paid()
    assert t.problems == [] and t.tables["detail"].count() == 30 and t.lists["definitions"][0]["term"] == "NTL"
    assert t.catalog.get("total_roas").numerator == "total_raised" and t.catalog.get("gross_cpa").denominator == "ntl"
    y = t.tables["year_to_date"].first()
    assert y["gross_spend"] == pytest.approx(sum(r[4] for r in detail)) and y["gross_cpa"] == pytest.approx(y["gross_spend"] / sum(r[5] for r in detail))
    s = t.tables["monthly_series"].where("metric_key = 'gross_spend'").orderBy("row").collect()
    assert s[-1]["running_total"] == pytest.approx(y["gross_spend"]) and s[-1]["step_cells"] == ["F18", "F19", "F20"]


def test_p2p(report):
    t = report.tabs["p2p"]
    _, rows = wb.p2p()
    assert not t.failed and t.tables["detail"].count() == 24
    assert [m.key for m in t.catalog.metrics] == ["gross_spend", "ntl", "gross_cpa", "immediate_raised", "donors", "average_gift", "click_rate"]
    assert any("Source Code" in f for f in t.findings) and any("Click Rate" in p["text"] for p in t.problems)
    q = t.tables["quarter_to_date"].first()
    assert q["gross_spend"] == sum(r[3] for r in rows) and q["gross_cpa"] == pytest.approx(q["gross_spend"] / sum(r[4] for r in rows)) and q["click_rate"] is None
    m = {r["label"]: r for r in t.tables["monthly"].collect()}
    assert m["July"]["row_count"] == 12 and m["July"]["average_gift"] == pytest.approx(sum(r[5] for r in rows if r[0] == "July") / sum(r[6] for r in rows if r[0] == "July"))
    s = t.tables["series"].where("slice_type = 'audience' AND metric_key = 'donors'").collect()
    assert sum(r["step"] for r in s) < sum(r[6] for r in rows)  # rows without an audience
    last = t.tables["series"].where("slice_type = 'all' AND metric_key = 'donors'").orderBy("period_ord").collect()[-1]
    assert last["running_total"] == sum(r[6] for r in rows) and t.lists["audience"] == ["A", "b"]


def test_email_and_high_dollar(report):
    t = report.tabs["email"]
    assert not t.failed and {r["label"] for r in t.tables["monthly"].collect()} == {"July 2026", "August 2026", "September 2026"}
    assert any("Open Rate" in p["text"] for p in t.problems)
    h = report.tabs["high_dollar"]
    assert h.meta == {"year": 2026.0, "quarter": 3.0} and h.tables["quarter_to_date"].first()["amount"] == 29500
    by = {r["slice_value"]: r["running_total"] for r in h.tables["series"].where("slice_type = 'category'").collect()}
    assert sum(by.values()) == 29000 and by["Website"] == 17000 and h.lists["category"] == ["Ads", "Email", "P2P", "Website"]
    assert {r["finance_claim"] for r in h.tables["detail"].collect()} == {True, False} and h.tables["detail"].where("authentic_added").count() == 0


def test_corruption_flags_and_errors(spark, tmp_path):
    sheets = wb.everything()
    sheets["Digital Report"]["E15"] = 0.99
    sheets["Paid Media Report"]["F23"] = 99999.0
    for i in range(24):
        sheets["P2P Statistics"][f"G{5 + i}"] = 77.0
    r = build(spark, cells_of(spark, sheets), "x")
    d = r.tabs["digital"].problems
    assert [(p["level"], p["rule_id"], p["cells"][0][:3], p["sections"]) for p in d] == [("flag", "RC1", "E15", ["s-hero", "s-channel"])]
    assert r.tabs["paid"].failed and {p["rule_id"] for p in r.tabs["paid"].problems if p["level"] == "error"} == {"RC5"}
    p = next(p for p in r.tabs["p2p"].problems if p["level"] == "flag")
    assert len(p["cells"]) == 6 and p["more_cells"] == 18 - 6 and "Gross CPA" in p["text"]
    assert set(r.shown) == {"digital", "p2p", "email", "high_dollar"} and r.problems.where("level = 'flag'").count() >= 2
    with pytest.raises(Refused):
        r.write(str(tmp_path / "strict"))
    assert not (tmp_path / "strict").exists()
    assert len(r.write(str(tmp_path / "lenient"), strict=False)) == 4


def test_overall_mismatch_and_missing_tabs(spark):
    sheets = {"Digital Report": wb.digital(), "My P2P Statistics 2026": wb.p2p()[0], "Email Statistics": {"A1": "x"}}
    row = 14 + 8 + 2
    sheets["Digital Report"][f"H{row}"] = 1.0
    r = build(spark, cells_of(spark, sheets), "x")
    assert {p["rule_id"] for p in r.tabs["digital"].problems} == {"RC2"}
    assert r.tabs["p2p"].problems[0]["level"] == "warn" and not r.tabs["p2p"].failed
    assert r.tabs["paid"].failed and r.tabs["email"].failed and "header row" in r.tabs["email"].problems[0]["text"]


def test_snapshots(spark, report, tmp_path):
    out = report.write(str(tmp_path))
    assert len(out) == 5
    high = json.loads((tmp_path / "high-dollar-data.json").read_text())
    assert high["quarter_to_date"][0]["amount"] == 29500 and high["meta"]["quarter"] == 3
    assert read_snapshot(spark, out[0]).count() == 1


def test_frames_are_bounded(spark, tmp_path, monkeypatch):
    """A sheet goes on in frames of FRAME cells, whatever its size; finished rows leave the tree."""
    from tallyloom.sources import workbook as w

    body = "".join(f'<row r="{i}"><c r="A{i}"><v>{i}</v></c><c r="B{i}" t="inlineStr"><is><t>x</t></is></c></row>' for i in range(1, 3001))
    data = wb.workbook({"S": body})
    monkeypatch.setattr(w, "FRAME", 1000)
    sizes = [len(f) for f in w.frames(w.parse(data, "x"), [x.strip().split(" ")[0] for x in w.CELLS.split(",")])]
    assert max(sizes) == 1000 and sum(sizes) == 6001
    (tmp_path / "s.xlsx").write_bytes(data)
    assert read_cells(spark, str(tmp_path / "s.xlsx")).where("kind = 'number'").count() == 3000


def test_anchors_at_the_edge(spark):
    """A heading in row 200 is found, with its header below; one in row 201 is not."""
    for shift, found in ((188, True), (189, False)):
        moved = {}
        for ref, v in wb.digital().items():
            letters_, row = ref.rstrip("0123456789"), int(ref[len(ref.rstrip("0123456789")) :])
            moved[f"{letters_}{row + shift if row >= 12 else row}"] = v
        t = build(spark, cells_of(spark, {"Digital Report": moved}), "x").tabs["digital"]
        # the overall row lies below the depth of the search in both
        assert ("channel_period" in t.tables) == found and any("Quarterly Toplines" in p["text"] for p in t.problems) != found


def test_a_write_is_whole_or_not_at_all(spark, report, tmp_path, monkeypatch):
    from tallyloom.sources import documents

    out = report.write(str(tmp_path / "a"), paths={"paid": str(tmp_path / "b" / "pm.json")})
    before = {p: open(p).read() for p in out}
    put, calls = documents._put, []

    def fails(uri, text):
        calls.append(uri)
        if documents.STAGED in uri and len(calls) > 2:
            raise OSError("disk full")
        put(uri, text)

    monkeypatch.setattr(documents, "_put", fails)
    writer = documents.DocumentWriter(str(tmp_path / "a"))
    with pytest.raises(OSError, match="disk full"):
        writer.write(iter([{"path": p, "document": "new"} for p in out]))
    writer.abort([])
    assert {p: open(p).read() for p in out} == before and not [p for p in (tmp_path / "a").iterdir() if p.name.startswith(documents.STAGED)]


def test_reports_of_many(spark):
    """Workbooks with other months, metrics, faults and missing tabs in one plan; each as if it were alone."""
    from functools import reduce

    from pyspark.sql import DataFrame

    from tallyloom.plans.many import Reports
    from tallyloom.sources.workbook import CELLS

    odd = wb.everything()
    odd["Paid Media Report"]["F18"] = 1.0
    odd["Digital Report"]["E15"] = 0.99
    books = {"a": wb.everything(), "b": {"P2P Statistics": wb.p2p()[0]}, "c": {"X": {"A1": 1}}, "d": odd, "e": {"High-Dollar Donations": wb.high_dollar(), "Email Statistics": wb.email()}}
    parts = [spark.createDataFrame(list(parse(wb.workbook(s), k)), CELLS) for k, s in books.items()]
    many = Reports(reduce(DataFrame.unionByName, parts))
    problems = sorted((r["workbook"], r["tab"], r["level"], r["rule_id"], r["text"], tuple(r["cells"])) for r in many.problems.collect())
    alone = []
    for (k, _), cells in zip(books.items(), parts, strict=True):
        r = build(spark, cells, k)
        alone += [(k, p["tab"], p["level"], p["rule_id"], p["text"], tuple(p["cells"])) for t in r.tabs.values() for p in t.problems]
        r.close()
    assert problems == sorted(alone)
    assert {(r["workbook"], r["tab"]) for r in many.published.collect()} >= {("a", "paid"), ("b", "p2p"), ("d", "p2p"), ("e", "high_dollar")}
    assert ("d", "paid") not in {(r["workbook"], r["tab"]) for r in many.published.collect()}
    got = {(r["workbook"], r["metric_key"]): r["value"] for r in many.rollup().where("level = 'total' AND tab = 'p2p'").collect()}
    assert got["a", "gross_spend"] == got["b", "gross_spend"] == sum(r[3] for r in wb.p2p()[1])


def test_customers_are_not_broadcast(spark):
    from tallyloom.plans import queries, workbook_queries

    d = "/root/testdata/sf0.001"
    if not os.path.isdir(d):
        return
    for rows in (workbook_queries._p2p(spark, d, "x", "P2P Statistics"), queries.topic_detail(spark, d)):
        plan = rows._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" in plan and "BroadcastHashJoin" not in plan
