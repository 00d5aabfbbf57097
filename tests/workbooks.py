"""Synthetic workbooks: {sheet: {A1: value}}; a value of (value, formula) has a formula."""

import io
import zipfile
from xml.sax.saxutils import escape


def cell_xml(ref, value):
    value, formula = value if isinstance(value, tuple) else (value, None)
    f = f"<f>{escape(formula)}</f>" if formula else ""
    if value is None:
        return f'<c r="{ref}">{f}</c>'
    if isinstance(value, bool):
        return f'<c r="{ref}" t="b">{f}<v>{int(value)}</v></c>'
    if isinstance(value, (int, float)):
        return f'<c r="{ref}">{f}<v>{value!r}</v></c>'
    return f'<c r="{ref}" t="inlineStr">{f}<is><t>{escape(value)}</t></is></c>'


def workbook(sheets, extra=None):
    ns = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        names = "".join(f'<sheet name="{escape(n)}" sheetId="{i}" r:id="rId{i}"/>' for i, n in enumerate(sheets, 1))
        z.writestr("xl/workbook.xml", f'<workbook {ns} xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"><sheets>{names}</sheets></workbook>')
        rels = "".join(f'<Relationship Id="rId{i}" Target="worksheets/sheet{i}.xml"/>' for i in range(1, len(sheets) + 1))
        z.writestr("xl/_rels/workbook.xml.rels", f'<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships">{rels}</Relationships>')
        for i, cells in enumerate(sheets.values(), 1):
            body = cells if isinstance(cells, str) else "<row>" + "".join(cell_xml(r, v) for r, v in cells.items()) + "</row>"
            z.writestr(f"xl/worksheets/sheet{i}.xml", f"<worksheet {ns}><sheetData>{body}</sheetData></worksheet>")
        for name, data in (extra or {}).items():
            z.writestr(name, data)
    return out.getvalue()


def letters(n):
    out = ""
    while n:
        n, r = divmod(n - 1, 26)
        out = chr(65 + r) + out
    return out


def put(cells, row, first, values):
    for i, v in enumerate(values):
        if v is not None:
            cells[f"{letters(first + i)}{row}"] = v


def digital(channels=8, months=("July", "August", "September"), unreported=0):
    c = {"B4": "Fundraising Toplines", "B6": "Client:", "C6": "Acme", "B7": "Email Lead:", "C7": "Lee", "B9": "Year:", "C9": 2026, "B10": "Quarter:", "C10": 3, "B12": "Quarterly Toplines"}
    put(c, 13, 2, ["Channel", "Goal", "Actual", "% to Goal"])
    for m, name in enumerate(months):
        c[f"{letters(7 + 3 * m)}12"] = name
        put(c, 13, 7 + 3 * m, ["Goal", "Actual", "% to Goal"])
    total = [0.0] * (len(months) + 1)
    reported = len(months) - unreported
    for i in range(channels):
        row = 14 + i
        goals = [1000.0 * (i + 1) + 100 * m for m in range(len(months))]
        actual = [g * (0.4 + 0.1 * m) if m < reported else None for m, g in enumerate(goals)]
        got = sum(a for a in actual if a is not None)
        put(c, row, 2, [f"Channel {i}", (sum(goals), f"SUM(Q{row}:{letters(16 + len(months))}{row})"), got, got / sum(goals)])
        total[0] += got
        for m, (g, a) in enumerate(zip(goals, actual)):
            put(c, row, 7 + 3 * m, [g, a, a / g if a is not None else None])
            c[f"{letters(17 + m)}{row}"] = g
            total[m + 1] += a or 0
    row = 14 + channels + 1
    c[f"B{row}"] = "Overall"
    put(c, row + 1, 2, ["Total Raised", None, total[0]])
    for m in range(reported):
        c[f"{letters(8 + 3 * m)}{row + 1}"] = total[m + 1]
    return c


PAID_METRICS = ["Gross Spend", "NTL", "Gross CPA", "Immediate Raised", "Immediate ROAS", "Lifetime Raised", "Lifetime ROAS", "Total Raised", "Total ROAS"]


def paid_values(spend, ntl, now, later):
    both = now + later - 5
    return [spend, ntl, spend / ntl if ntl else None, now, now / spend, later, later / spend, both, both / spend]


def paid(months=("July", "August", "September"), per_month=10):
    c = {"B2": "Paid Media Report", "B4": "Year:", "C4": 2026, "B5": "Quarter:", "C5": 3, "B7": "Client:", "C7": "Acme", "F4": "NTL:", "G4": "Names that were new to the list"}
    detail = [(m, f"Ch{i % 3}", f"Place {i}", "Acquisition", 100.0 + 7 * i + k, (i + k) % 4 * 5, 50.0 * (i + 1), 20.0 * (k + 1)) for k, m in enumerate(months) for i in range(per_month)]
    sums = {m: [sum(r[j] for r in detail if r[0] == m) for j in (4, 5, 6, 7)] for m in months}
    put(c, 11, 2, ["Quarterly Toplines", None, None, "Quarter", *PAID_METRICS])
    row_of = lambda s, n: [s[0], s[1], s[0] / s[1], s[2], s[2] / s[0], s[3], s[3] / s[0], s[2] + s[3] - 5 * n, (s[2] + s[3] - 5 * n) / s[0]]
    whole = [sum(v[j] for v in sums.values()) for j in range(4)]
    put(c, 12, 5, [3, *row_of(whole, per_month * len(months))])
    put(c, 17, 2, ["Monthly Toplines", None, None, "Month", *PAID_METRICS])
    for k, m in enumerate(months):
        put(c, 18 + k, 5, [m, *row_of(sums[m], per_month)])
    put(c, 22, 2, ["Month", "Channel", "Placement", "Goal", *PAID_METRICS])
    for k, (m, ch, place, goal, *v) in enumerate(detail):
        put(c, 23 + k, 2, [m, ch, place, goal, *paid_values(*v)])
    return c, detail


def p2p():
    c = {"A1": "Year:", "B1": 2026, "A2": "Quarter:", "B2": 3}
    put(c, 4, 1, ["Month", "Date", "Topic", "Audience", "Gross Spend", "NTL", "Gross CPA", "Immediate Raised", "Donors", "Average Gift", "Click Rate", "Source Code", "Helper 1"])
    rows = []
    for i in range(24):
        month, topic, audience = ["July", "August "][i % 2], f"T{i % 3}", ["A", "b", None][i % 3 if i % 5 else 2]
        spend, ntl, raised, donors = 10.0 + i, i % 4, 25.0 * i, i % 6
        rows.append((month.strip(), topic, audience, spend, ntl, raised, donors))
        put(c, 5 + i, 1, [month, 46204 + i, topic, audience, f"${spend:,.2f}", ntl, spend / ntl if ntl else None, raised, donors, raised / donors if donors else None, 0.5, f"code{i}", 1])
    c["C40"] = "footer"
    return c, rows


def email():
    c = {"A1": "Year:", "B1": 2026, "A2": "Quarter:", "B2": 3}
    put(c, 3, 1, ["Date", "Send Time (ET)", "Mailing Topic", "Audience", "Label", "Raised", "Donors", "Average", "Recipients", "Donate Rate", "Open Rate"])
    for i in range(20):
        put(c, 4 + i, 1, [46204 + 4 * i, "9:00", f"M{i % 2}", f"A{i % 3}", f"label {i}", 100.0 * i, i, 100.0 if i else None, 1000, i / 1000, 0.3])
    return c


def high_dollar():
    c = {"A2": "a note"}
    put(c, 4, 1, ["category", "receipt_id", "date", "amount", "fundraising_page", "first", "last", "email", "Finance Claim", "Authentic Added"])
    amounts = {"Ads": [1500.0], "Email": [4000.0, 5000.0], "P2P": [1500.0], "Website": [8000.0, 9000.0], None: [500.0]}
    row = 5
    for cat, values in amounts.items():
        for v in values:
            put(c, row, 1, [cat, f"r{row}", 46237 + row, v, "page", "F", "L", "x@example.org", row % 2 == 0, None])
            row += 1
    return c


def everything():
    return {"Digital Report": digital(), "Paid Media Report": paid()[0], "P2P Statistics": p2p()[0], "Email Statistics": email(), "High-Dollar Donations": high_dollar()}
