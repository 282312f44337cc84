"""Workbooks made here, part by part, and read back."""

import zipfile

from bidlake.sources import workbooks

MAIN = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main" xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"'


def cell(place, value, kind="n", style=0):
    inner = f"<is><t>{value}</t></is>" if kind == "inlineStr" else f"<v>{value}</v>"
    return f'<c r="{place}" t="{kind}" s="{style}">{inner}</c>'


def write(path, sheets, strings=()):
    with zipfile.ZipFile(path, "w") as z:
        z.writestr("xl/workbook.xml", f"<workbook {MAIN}><sheets>" + "".join(f'<sheet name="{n}" sheetId="{i}" r:id="rId{i}"/>' for i, n in enumerate(sheets, 1)) + "</sheets></workbook>")
        z.writestr("xl/_rels/workbook.xml.rels", "<Relationships>" + "".join(f'<Relationship Id="rId{i}" Target="worksheets/sheet{i}.xml"/>' for i in range(1, len(sheets) + 1)) + "</Relationships>")
        z.writestr("xl/styles.xml", f'<styleSheet {MAIN}><numFmts><numFmt numFmtId="164" formatCode="dd/mm/yyyy"/><numFmt numFmtId="165" formatCode="&quot;day&quot; 0.00"/></numFmts><cellXfs><xf numFmtId="0"/><xf numFmtId="164"/><xf numFmtId="165"/></cellXfs></styleSheet>')
        z.writestr("xl/sharedStrings.xml", f"<sst {MAIN}>" + "".join(f"<si>{s}</si>" for s in strings) + "</sst>")
        for i, rows in enumerate(sheets.values(), 1):
            z.writestr(f"xl/worksheets/sheet{i}.xml", f"<worksheet {MAIN}><sheetData>" + "".join(f"<row>{''.join(r)}</row>" for r in rows) + "</sheetData></worksheet>")


def test_workbook(spark, tmp_path):
    text = lambda place, s: cell(place, s, "inlineStr")
    rows = [
        [text("A1", "Shree Steel"), text("B1", "Mumbai")],
        [],
        [text("A3", " "), cell("B3", 45356, style=1)],
        [cell("A4", 0, "s"), text("B4", "Qty"), text("D4", "Rate")],
        [text("A5", "Bolt"), cell("B5", "5.0"), cell("C5", "1", "b"), cell("D5", "2.12345678", style=2), cell("E5", "#N/A", "e")],
        [text("A6", "Nut"), cell("B6", 7), cell("E6", "formula text", "str")],
    ]
    write(tmp_path / "a.xlsx", {"Offer": rows, "Empty": [], "Numbers": [[cell("A1", 1), cell("B1", 2)], [cell("A2", 3)]]}, ["<r><t>Item </t></r><r><t>name</t></r><rPh><t>x</t></rPh>"])
    (tmp_path / "b.xlsx").write_bytes(b"PK\x03\x04 no workbook")
    got = workbooks.read_workbooks(spark, str(tmp_path))
    bad = got.where("error is not null").collect()
    assert [(r.path.rsplit("/", 1)[1], r.sheet) for r in bad] == [("b.xlsx", None)]
    heads = {r.sheet: (r.sheet_no, r.header_row, r.headers) for r in workbooks.headers(got).collect()}
    assert heads == {"Offer": (1, 3, ["Item name", "Qty", "col_3", "Rate", "col_5"]), "Numbers": (3, 1, ["1", "2"])}
    body = {(r.sheet, r.row): r.cells for r in workbooks.sheet_tables(got).collect()}
    assert body == {("Offer", 1): ["Bolt", "5", "True", "2.123457", None], ("Offer", 2): ["Nut", "7", None, None, "formula text"], ("Numbers", 1): ["3", None]}
    texts = {r.sheet: r.text for r in workbooks.sheet_texts(got).collect()}
    assert texts["Offer"] == "=== Sheet: Offer ===\nShree Steel Mumbai\n2024-03-05T00:00:00\nItem name | Qty | col_3 | Rate | col_5\nBolt | 5 | True | 2.123457 | \nNut | 7 |  |  | formula text"
    assert texts["Numbers"] == "=== Sheet: Numbers ===\n1 | 2\n3 | "


def test_header_beyond_the_first_rows_is_not_taken(spark, tmp_path):
    rows = [[cell(f"A{i}", i), cell(f"B{i}", i)] for i in range(1, 21)] + [[cell("A21", "Item", "inlineStr"), cell("B21", "Qty", "inlineStr")], [cell("A22", 5), cell("B22", 6)]]
    write(tmp_path / "a.xlsx", {"S": rows, "T": rows[1:]})
    assert [r.header_row for r in workbooks.headers(workbooks.read_workbooks(spark, str(tmp_path))).orderBy("sheet_no").collect()] == [1, 20]
