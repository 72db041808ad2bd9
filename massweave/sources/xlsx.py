"""Workbooks of result tables, written with the standard library only."""

from __future__ import annotations

import math
import re
import zipfile
from collections.abc import Iterable, Sequence
from xml.sax.saxutils import escape

#: Most rows a sheet can hold.
MOST_ROWS = 1_048_576

_MAIN = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"
_REL = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
_PACKAGE = "http://schemas.openxmlformats.org/package/2006"
_HEAD = '<?xml version="1.0" encoding="UTF-8" standalone="yes"?>\n'
_UNPRINTABLE = re.compile(r"[\x00-\x08\x0b\x0c\x0e-\x1f￾￿]")


def column_letters(k: int) -> str:
    """Letters of the k-th column, counted from 0."""
    out = ""
    k += 1
    while k:
        k, rest = divmod(k - 1, 26)
        out = chr(65 + rest) + out
    return out


def _cell(at: str, value) -> str:
    if value is None or (isinstance(value, float) and math.isnan(value)):
        return ""
    if isinstance(value, bool):
        return f'<c r="{at}" t="b"><v>{int(value)}</v></c>'
    if isinstance(value, (int, float)) and math.isfinite(value):
        return f'<c r="{at}"><v>{value!r}</v></c>'
    text = escape(_UNPRINTABLE.sub("", str(value)))
    return f'<c r="{at}" t="inlineStr"><is><t xml:space="preserve">{text}</t></is></c>'


def _sheet(columns: Sequence[str], rows: Iterable[Sequence]) -> Iterable[str]:
    yield f'{_HEAD}<worksheet xmlns="{_MAIN}"><sheetData>'
    for r, row in enumerate(_with_header(columns, rows), start=1):
        if r > MOST_ROWS:
            raise ValueError(f"a sheet holds at most {MOST_ROWS} rows; write the tables to files instead")
        yield f'<row r="{r}">' + "".join(_cell(f"{column_letters(c)}{r}", v) for c, v in enumerate(row)) + "</row>"
    yield "</sheetData></worksheet>"


def _with_header(columns: Sequence[str], rows: Iterable[Sequence]) -> Iterable[Sequence]:
    yield columns
    yield from rows


def write_workbook(path: str, sheets: dict[str, tuple[Sequence[str], Iterable[Sequence]]]) -> None:
    """Write named sheets, each ``(columns, rows)``; rows are streamed."""
    names = list(sheets)
    tags = "".join(f'<sheet name="{escape(n, {chr(34): "&quot;"})}" sheetId="{k}" r:id="rId{k}"/>' for k, n in enumerate(names, 1))
    kind = f"{_REL}/worksheet"
    links = "".join(f'<Relationship Id="rId{k}" Type="{kind}" Target="worksheets/sheet{k}.xml"/>' for k in range(1, len(names) + 1))
    parts = "".join(
        f'<Override PartName="/xl/worksheets/sheet{k}.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.worksheet+xml"/>'
        for k in range(1, len(names) + 1)
    )
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr(
            "[Content_Types].xml",
            f'{_HEAD}<Types xmlns="{_PACKAGE}/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/>'
            '<Default Extension="xml" ContentType="application/xml"/><Override PartName="/xl/workbook.xml" '
            f'ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.sheet.main+xml"/>{parts}</Types>',
        )
        z.writestr(
            "_rels/.rels",
            f'{_HEAD}<Relationships xmlns="{_PACKAGE}/relationships"><Relationship Id="rId1" Type="{_REL}/officeDocument" Target="xl/workbook.xml"/></Relationships>',
        )
        z.writestr("xl/workbook.xml", f'{_HEAD}<workbook xmlns="{_MAIN}" xmlns:r="{_REL}"><sheets>{tags}</sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", f'{_HEAD}<Relationships xmlns="{_PACKAGE}/relationships">{links}</Relationships>')
        for k, name in enumerate(names, 1):
            with z.open(f"xl/worksheets/sheet{k}.xml", "w", force_zip64=True) as f:
                for piece in _sheet(*sheets[name]):
                    f.write(piece.encode())
