"""Cells of a worksheet as text: sheet order, number formats and both date epochs."""

from __future__ import annotations

import datetime as dt
import io
import posixpath
import re
import zipfile
from xml.etree import ElementTree

_MAIN = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
_REL = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}"
_PACKAGE = "{http://schemas.openxmlformats.org/package/2006/relationships}"
# Built-in number formats that show a date or a time.
_DATE_FORMATS = {*range(14, 23), *range(27, 37), 45, 46, 47, *range(50, 59)}


def _text(node) -> str:
    """Plain and formatted runs of a string; reading aids beside the characters don't count."""
    parts = [*node.findall(f"{_MAIN}t"), *(t for r in node.findall(f"{_MAIN}r") for t in r.findall(f"{_MAIN}t"))]
    return "".join(t.text or "" for t in parts)


def shows_date(code: str) -> bool:
    """Whether a custom number format has a date or time part outside quotes, colours and conditions."""
    bare = re.sub(r'"[^"]*"|\\.|_.|\*.', "", code.split(";")[0])
    elapsed = re.search(r"\[(h+|m+|s+)\]", bare, re.I)
    bare = re.sub(r"\[[^\]]*\]", "", bare)
    if re.fullmatch(r"(?i)\s*general\s*", bare):
        return False
    return bool(elapsed or re.search(r"[ymdhs]", bare, re.I))


def from_serial(number: float, epoch_1904: bool) -> str:
    """ISO text of a day number; under one day a time only.

    The older epoch counts a 29 February 1900 that never was: day 60 has no date
    and stays a number, days before it lie one later than the count says.
    """
    # a double has room for milliseconds, not for more
    micros = round(number * 86_400_000) * 1000
    days, rest = divmod(micros, 86_400_000_000)
    clock = (dt.datetime.min + dt.timedelta(microseconds=rest)).time().isoformat()
    if days < 0 or (not epoch_1904 and days == 60):
        return f"{number:.15g}"
    if days == 0:
        return clock
    start = dt.date(1904, 1, 1) if epoch_1904 else dt.date(1899, 12, 31 if days < 60 else 30)
    try:
        day = (start + dt.timedelta(days=days)).isoformat()
    except OverflowError:
        return f"{number:.15g}"
    return day if rest == 0 else f"{day} {clock}"


def _date_styles(book: zipfile.ZipFile) -> list[bool]:
    """For each cell style, whether its numbers are dates."""
    if "xl/styles.xml" not in book.namelist():
        return []
    root = ElementTree.fromstring(book.read("xl/styles.xml"))
    custom = {int(f.get("numFmtId")): shows_date(f.get("formatCode", "")) for f in root.iter(f"{_MAIN}numFmt")}
    cells = root.find(f"{_MAIN}cellXfs")
    ids = [int(x.get("numFmtId", 0)) for x in (cells if cells is not None else ())]
    return [custom.get(i, i in _DATE_FORMATS) for i in ids]


def sheet_paths(book: zipfile.ZipFile) -> list[tuple[str, str]]:
    """(name, file) of the worksheets in the order of their tabs; by file number where the list of tabs is missing."""
    if not {"xl/workbook.xml", "xl/_rels/workbook.xml.rels"} <= set(book.namelist()):
        files = [n for n in book.namelist() if re.fullmatch(r"xl/worksheets/sheet\d+\.xml", n)]
        return [(posixpath.basename(n).removesuffix(".xml"), n) for n in sorted(files, key=lambda n: int(re.sub(r"\D", "", n)))]
    root = ElementTree.fromstring(book.read("xl/workbook.xml"))
    links = ElementTree.fromstring(book.read("xl/_rels/workbook.xml.rels"))
    found = {r.get("Id"): (r.get("Type", ""), r.get("Target", "")) for r in links.iter(f"{_PACKAGE}Relationship")}
    out = []
    for sheet in root.iter(f"{_MAIN}sheet"):
        kind, target = found.get(sheet.get(f"{_REL}id"), ("", ""))
        if kind.endswith("/worksheet"):
            out.append((sheet.get("name"), target.lstrip("/") if target.startswith("/") else posixpath.normpath(posixpath.join("xl", target))))
    return out


def _column(reference: str) -> int:
    at = 0
    for letter in re.match(r"[A-Z]+", reference).group():
        at = at * 26 + ord(letter) - 64
    return at - 1


def sheet_rows(content: bytes, sheet: str | None = None) -> list[list[str | None]]:
    """Cell texts of a worksheet (default: the first tab), each at the place its reference names.

    Dates become ISO text, numbers stay as written, booleans TRUE or FALSE; error
    cells and empty ones are None. Rows that the file leaves out are left out too.
    """
    with zipfile.ZipFile(io.BytesIO(content)) as book:
        sheets = sheet_paths(book)
        wanted = [p for n, p in sheets if sheet is None or n == sheet]
        if not wanted:
            raise ValueError("The workbook has no worksheet." if sheet is None else f"The workbook has no worksheet '{sheet}'.")
        settings = ElementTree.fromstring(book.read("xl/workbook.xml")).find(f"{_MAIN}workbookPr") if "xl/workbook.xml" in book.namelist() else None
        late = settings is not None and settings.get("date1904", "0") in ("1", "true")
        shared = []
        if "xl/sharedStrings.xml" in book.namelist():
            shared = [_text(si) for si in ElementTree.fromstring(book.read("xl/sharedStrings.xml")).iter(f"{_MAIN}si")]
        dates = _date_styles(book)

        def value(cell) -> str | None:
            kind, inline, raw = cell.get("t", "n"), cell.find(f"{_MAIN}is"), cell.findtext(f"{_MAIN}v")
            if kind == "inlineStr" or inline is not None:
                return _text(inline) if inline is not None else None
            if raw is None or kind == "e":
                return None
            if kind == "s":
                return shared[int(raw)]
            if kind == "b":
                return "TRUE" if raw.strip() in ("1", "true") else "FALSE"
            style = int(cell.get("s", 0))
            if kind == "n" and style < len(dates) and dates[style]:
                return from_serial(float(raw), late)
            return raw.replace("T", " ") if kind == "d" else raw

        rows = []
        for row in ElementTree.fromstring(book.read(wanted[0])).iter(f"{_MAIN}row"):
            cells: dict[int, str | None] = {}
            for cell in row.iter(f"{_MAIN}c"):
                # a cell without a reference follows the one before it
                at = _column(cell.get("r")) if cell.get("r") else max(cells, default=-1) + 1
                cells[at] = value(cell)
            rows.append([cells.get(i) for i in range(max(cells, default=-1) + 1)])
        return rows
