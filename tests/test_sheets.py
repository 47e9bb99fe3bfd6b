"""Spreadsheets written here come back typed."""

import zipfile

import pytest

from plumbline.sources import files, sheets

BOOK = '<workbook xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main" xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"><sheets><sheet name="calls" sheetId="1" r:id="rId1"/><sheet name="more" sheetId="2" r:id="rId2"/></sheets></workbook>'
LINKS = '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="rId1" Target="worksheets/sheet1.xml"/><Relationship Id="rId2" Target="/xl/worksheets/sheet2.xml"/></Relationships>'
SHARED = '<sst xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"><si><t>id</t></si><si><t>score</t></si><si><r><t>na</t></r><r><t>me</t></r></si><si><t>é &amp; &lt;x&gt;</t></si></sst>'
MAIN = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"


def write(path, n=2500):
    rows = ['<row r="1"><c r="A1" t="s"><v>0</v></c><c r="B1" t="s"><v>1</v></c><c r="C1" t="s"><v>2</v></c><c r="E1" t="inlineStr"><is><t>state</t></is></c></row>']
    for k in range(n):
        r = k + 3  # the second row is empty
        score = f'<c r="B{r}"><v>{k / 8}</v></c>' if k % 5 else ""
        name = f'<c r="C{r}" t="s"><v>3</v></c>' if k % 2 else f'<c r="C{r}" t="str"><f>A1</f><v>f{k}</v></c>'
        rows.append(f'<row r="{r}"><c r="A{r}"><v>{k}</v></c>{score}{name}<c r="D{r}" t="e"><v>#N/A</v></c><c r="E{r}" t="b"><v>{k % 2}</v></c></row>')
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("xl/workbook.xml", BOOK)
        z.writestr("xl/_rels/workbook.xml.rels", LINKS)
        z.writestr("xl/sharedStrings.xml", SHARED)
        z.writestr("xl/worksheets/sheet1.xml", f'<worksheet xmlns="{MAIN}"><sheetData>{"".join(rows)}<row r="{n + 9}"/></sheetData></worksheet>')
        z.writestr("xl/worksheets/sheet2.xml", f'<worksheet xmlns="{MAIN}"><sheetData><row><c><v>7</v></c></row><row><c><v>8</v></c><c><v>9</v></c></row></sheetData></worksheet>')


def test_sheet(spark, tmp_path):
    write(tmp_path / "x.xlsx")
    df = files.read(spark, str(tmp_path), "x.xlsx", id_column="id")
    assert df.dtypes == [("id", "bigint"), ("score", "double"), ("name", "string"), ("column_4", "bigint"), ("state", "bigint")]
    got = {r.id: (r.score, r.name, r.state) for r in df.collect()}
    assert len(got) == 2500 and df.where("column_4 is not null").count() == 0
    assert got[3] == (0.375, "é & <x>", 1) and got[4] == (0.5, "f4", 0) and got[5] == (None, "é & <x>", 1)
    assert files.read(spark, str(tmp_path), "x.xlsx", ["state"], "id").columns == ["id", "state"] or files.read(spark, str(tmp_path), "x.xlsx", ["state"]).columns == ["state"]
    more = sheets.read(spark, str(tmp_path / "x.xlsx"), "more")
    assert more.columns == ["7", "column_2"] and [tuple(r) for r in more.collect()] == [("8", "9")]
    with pytest.raises(Exception, match="no sheet"):
        sheets.read(spark, str(tmp_path / "x.xlsx"), "none")
    (tmp_path / "y.xls").write_bytes(b"")
    with pytest.raises(NotImplementedError):
        files.read(spark, str(tmp_path), "y.xls")


def test_column_numbers():
    assert [sheets.column_number(r) for r in ("A1", "Z9", "AA1", "AB7", "XFD1048576")] == [0, 25, 26, 27, 16383]
