"""Workbooks with several tabs, dates and both epochs."""

import io
import zipfile

import pytest

from seriesloom.sources import ingest
from seriesloom.sources.workbook import from_serial, sheet_rows, shows_date

MAIN = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
REL = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
DATES = """<row r="1"><c r="A1" t="inlineStr"><is><t>Month</t></is></c><c r="B1" t="s"><v>0</v></c><c r="C1" t="s"><v>1</v></c></row>
<row r="2"><c r="A2" s="1"><v>43831</v></c><c r="B2"><v>112</v></c><c r="C2" s="2"><v>0.5</v></c></row>
<row r="3"><c r="A3" s="3"><v>43862.75</v></c><c r="C3" t="b"><v>1</v></c></row>
<row r="4"><c r="A4" t="d"><v>2020-03-01T00:00:00</v></c><c r="B4" t="e"><v>#N/A</v></c><c r="C4" t="str"><v>text</v></c></row>
<row r="5"><c s="4"><v>7</v></c><c s="0"><v>43831</v></c></row>"""
OTHER = """<row r="1"><c r="A1" t="inlineStr"><is><t>other</t></is></c></row><row r="2"><c r="A2"><v>1</v></c></row>"""


def workbook(epoch="", first="rId7", second="rId3"):
    """The first tab lies in sheet2.xml; a chart tab comes before both."""
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("xl/workbook.xml", f'<workbook {MAIN} xmlns:r="{REL}"><workbookPr {epoch}/><sheets><sheet name="Chart" sheetId="1" r:id="rId1"/>'
                   f'<sheet name="Data" sheetId="9" r:id="{first}"/><sheet name="Other" sheetId="2" r:id="{second}"/></sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships">'
                   f'<Relationship Id="rId1" Type="{REL}/chartsheet" Target="chartsheets/sheet1.xml"/><Relationship Id="rId3" Type="{REL}/worksheet" Target="worksheets/sheet1.xml"/>'
                   f'<Relationship Id="rId7" Type="{REL}/worksheet" Target="/xl/worksheets/sheet2.xml"/></Relationships>')
        z.writestr("xl/sharedStrings.xml", f"<sst {MAIN}><si><t>Passengers</t></si><si><r><t>No</t></r><r><t>te</t></r><rPh sb='0' eb='1'><t>aid</t></rPh></si></sst>")
        z.writestr("xl/styles.xml", f'<styleSheet {MAIN}><numFmts><numFmt numFmtId="164" formatCode="yyyy\\-mm\\-dd hh:mm"/><numFmt numFmtId="165" formatCode="0&quot; days&quot;"/></numFmts>'
                   '<cellStyleXfs><xf numFmtId="14"/></cellStyleXfs><cellXfs><xf numFmtId="0"/><xf numFmtId="14"/><xf numFmtId="20"/><xf numFmtId="164"/><xf numFmtId="165"/></cellXfs></styleSheet>')
        z.writestr("xl/worksheets/sheet1.xml", f"<worksheet {MAIN}><sheetData>{OTHER}</sheetData></worksheet>")
        z.writestr("xl/worksheets/sheet2.xml", f"<worksheet {MAIN}><sheetData>{DATES}</sheetData></worksheet>")
    return out.getvalue()


def test_first_tab_with_dates():
    assert sheet_rows(workbook()) == [["Month", "Passengers", "Note"], ["2020-01-01", "112", "12:00:00"], ["2020-02-01 18:00:00", None, "TRUE"],
                                      ["2020-03-01 00:00:00", None, "text"], ["7", "43831"]]
    assert sheet_rows(workbook(), "Other") == [["other"], ["1"]] == sheet_rows(workbook(first="rId3", second="rId7"))
    with pytest.raises(ValueError, match="Chart"):
        sheet_rows(workbook(), "Chart")
    assert sheet_rows(workbook('date1904="1"'))[1][0] == "2024-01-02"


def test_serials():
    assert [from_serial(n, False) for n in (1, 59, 60, 61, 2958465, 0.25, -1, 43831.000011574)] == [
        "1900-01-01", "1900-02-28", "60", "1900-03-01", "9999-12-31", "06:00:00", "-1", "2020-01-01 00:00:01"]
    assert [from_serial(n, True) for n in (0.5, 1, 60, 1e9)] == ["12:00:00", "1904-01-02", "1904-03-01", "1000000000"]


@pytest.mark.parametrize("code, date", [("General", False), ("0.00", False), ("yyyy", True), ('0 "days"', False), ("[Red]0", False), ("[h]:mm", True), ("d/m", True), ("#,##0;[Red]-#,##0", False),
                                        ("[$-409]mmm yy", True), (r"0\h", False), ("_(0_)", False)])
def test_formats(code, date):
    assert shows_date(code) is date


def test_read_workbooks(spark, tmp_path):
    (tmp_path / "a.xlsx").write_bytes(workbook())
    (tmp_path / "b.xlsx").write_bytes(workbook('date1904="1"'))
    table = ingest.xlsx_table(ingest.read_xlsx(spark, str(tmp_path)), ["Month", "Passengers"])
    rows = ingest.finalise(table.filter("path like '%a.xlsx'").withColumn("Passengers", table["Passengers"].try_cast("double")), "Month", "Passengers").orderBy("ts").collect()
    assert [(str(r["ts"]), r["value"]) for r in rows][:2] == [("2020-01-01 00:00:00", 112.0), ("2020-02-01 18:00:00", None)]
    assert ingest.read_xlsx(spark, str(tmp_path), "Other").count() == 2
