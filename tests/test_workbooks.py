"""Workbooks written by hand, read as rows, and indexed."""

import zipfile

from tessera.operators import typed_index
from tessera.sources import rooms, workbooks

MAIN = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
REL = 'xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"'
STYLES = f'<styleSheet {MAIN}><numFmts count="2"><numFmt numFmtId="170" formatCode="yyyy\\-mm"/><numFmt numFmtId="171" formatCode="&quot;day&quot; 0.0"/></numFmts><cellXfs count="4"><xf numFmtId="0"/><xf numFmtId="14"/><xf numFmtId="170"/><xf numFmtId="171"/></cellXfs></styleSheet>'
FIRST = f"""<worksheet {MAIN}><sheetData>
<row r="1"><c r="A1" t="s"><v>0</v></c><c r="B1" t="inlineStr"><is><t>Revenue </t><r><t>($M)</t></r></is></c></row>
<row r="2"><c r="A2" s="1"><v>45663</v></c><c r="B2"><v>1.5</v></c><c r="D2" t="b"><v>1</v></c></row>
<row r="3"><c r="A3" s="1"><v>45670</v></c><c r="B3"><f>B2*2</f><v>3</v></c><c r="C3" t="e"><v>#DIV/0!</v></c><c r="D3" t="s"><v>1</v></c></row>
<row r="4"><c r="A4" s="2"><v>45677.5</v></c><c r="B4" s="3"><v>7</v></c><c r="C4" t="str"><v>said</v></c></row>
<row r="6"><c r="A6" t="s"><v>1</v></c></row>
<row><c s="1"><v>0.25</v></c><c><v>1E3</v></c></row>
</sheetData></worksheet>"""


def book(path, first=FIRST):
    with zipfile.ZipFile(path, "w") as z:
        z.writestr("xl/workbook.xml", f'<workbook {MAIN} {REL}><sheets><sheet name="My Sheet" sheetId="1" r:id="x1"/><sheet name="Two" sheetId="2" r:id="x2"/></sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="x1" Target="worksheets/sheet1.xml"/><Relationship Id="x2" Target="/xl/worksheets/sheet2.xml"/></Relationships>')
        z.writestr("xl/sharedStrings.xml", f"<sst {MAIN}><si><t>Week</t></si><si><t>  </t></si></sst>")
        z.writestr("xl/styles.xml", STYLES)
        z.writestr("xl/worksheets/sheet1.xml", first)
        z.writestr("xl/worksheets/sheet2.xml", f'<worksheet {MAIN}><sheetData><row r="9"><c r="AB9"><v>5</v></c></row></sheetData></worksheet>')


def test_rows_of_sheets(spark, tmp_path):
    (tmp_path / "room" / "sub").mkdir(parents=True)
    book(tmp_path / "room" / "sub" / "B.xlsx")
    (tmp_path / "room" / "no.xlsx").write_bytes(b"not a workbook")
    (tmp_path / "room" / "~$B.xlsx").write_bytes(b"lock")
    got = workbooks.workbook_sections(rooms.room_files(spark, f"file://{tmp_path}/room")).orderBy("ordinal").collect()
    assert [(r["anchor"], r["heading"], r["text"]) for r in got] == [
        ("sub/B.xlsx#My Sheet!A1", "My Sheet", "Week | Revenue ($M)"),
        ("sub/B.xlsx#My Sheet!A2", "My Sheet", "2025-01-06T00:00:00 | 1.5 | True"),
        ("sub/B.xlsx#My Sheet!A3", "My Sheet", "2025-01-13T00:00:00 | 3 | #DIV/0!"),
        ("sub/B.xlsx#My Sheet!A4", "My Sheet", "2025-01-20T12:00:00 | 7 | said"),
        ("sub/B.xlsx#My Sheet!A7", "My Sheet", "06:00:00 | 1000.0"),
        ("sub/B.xlsx#Two!AB9", "Two", "5"),
    ]
    assert [(c["ref"], c["value"], c["number"]) for c in got[2]["cells"]] == [("A3", "2025-01-13T00:00:00", None), ("B3", "3", 3.0), ("C3", "#DIV/0!", None)]


def test_a_room_with_a_workbook_is_indexed(spark, tmp_path):
    room = tmp_path / "room"
    room.mkdir()
    book(room / "B.xlsx")
    (room / "a.csv").write_text("Item,Value\nPump NQ-17,5\n")
    (room / "n.md").write_text("Paid $5m on 6 January 2025\n")
    (room / "brief.md").write_text("not of the room NQ-99")
    sections = rooms.typed_sections(spark, f"file://{room}")
    assert {c["ref"] for r in sections.where("doc = 'a.csv'").collect() for c in r["cells"]} == {"r1c1", "r1c2", "r2c1", "r2c2"}
    index = {(r["kind"], r["value"], r["unit"]): r for r in typed_index.records(typed_index.build_index(sections)).collect()}
    assert index["amount", "1500000", "USD"]["anchor"] == "B.xlsx#My Sheet!B2" and index["amount", "5000000", "USD"]["anchor"] == "n.md#l1"
    assert index["date", "2025-01-06", None]["n_docs"] == 2 and index["identifier", "NQ-17", None]["anchor"] == "a.csv#r2"
    series = [r for k, r in index.items() if k[0] == "series"]
    assert [(r["surface"], r["anchor"], r["context"]) for r in series] == [("Week", "B.xlsx#My Sheet!A1", "3 week rows from 2025-01-06 to 2025-01-20")]


def test_documents_of_a_room_with_and_without_a_key(spark, tmp_path):
    room = tmp_path / "room"
    (room / "x").mkdir(parents=True)
    for name in ("x/b.md", "a.txt", "c.bin", "brief.md", "x/brief.md"):
        (room / name).write_text("text")
    rows = lambda: [tuple(r) for r in rooms.room_documents(spark, f"file://{room}").orderBy("place").collect()]
    assert rows() == [("a.txt", "a.txt", 1), ("x/b.md", "x/b.md", 2), ("x/brief.md", "x/brief.md", 3)]
    (room / "key.json").write_text('{"documents": {"D2": "x/b.md", "D1": "a.txt"}, "bar": 1}')
    assert rows() == [("D2", "x/b.md", 1), ("D1", "a.txt", 2)]
