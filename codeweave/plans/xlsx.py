"""An export as a workbook: plain XLSX bytes of a result of lookups, which is small by its top-n."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterable
from xml.sax.saxutils import escape

from pyspark.sql import DataFrame

from ..operators.ingest import EXPORT

#: Column titles.
TITLES = [
    "Anchor Code", "Row Type", "Similarity", "Method", "Province", "FSC Code", "FSC Name / Function", "Chapter", "Section", "Subsection", "Description", "Price", "FSC Rationale", "FSC Confidence", "Page",
    "FSC Key Observations", "FSC Notes", "FSC Others", "NGS Code", "NGS Label", "NGS Rationale", "NGS Confidence", "NGS Key Observations", "NGS Notes", "NGS Other", "Map Date",
]
_TYPES = '<?xml version="1.0"?><Types xmlns="http://schemas.openxmlformats.org/package/2006/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Default Extension="xml" ContentType="application/xml"/><Override PartName="/xl/workbook.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.sheet.main+xml"/><Override PartName="/xl/worksheets/sheet1.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.worksheet+xml"/><Override PartName="/xl/styles.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.styles+xml"/></Types>'
_RELS = '<?xml version="1.0"?><Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="r1" Type="http://schemas.openxmlformats.org/officeDocument/2006/relationships/officeDocument" Target="xl/workbook.xml"/></Relationships>'
_BOOK = '<?xml version="1.0"?><workbook xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main" xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"><sheets><sheet name="Matches" sheetId="1" r:id="r1"/></sheets></workbook>'
_BOOK_RELS = '<?xml version="1.0"?><Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="r1" Type="http://schemas.openxmlformats.org/officeDocument/2006/relationships/worksheet" Target="worksheets/sheet1.xml"/><Relationship Id="r2" Type="http://schemas.openxmlformats.org/officeDocument/2006/relationships/styles" Target="styles.xml"/></Relationships>'
#: Cell styles: 0 body, 1 header, 2 anchor, 3 same category, 4 ON, 5 BC, 6 YT.
_FILLS = ["1F4E79", "FFE699", "E2EFDA", "DDEEFF", "E8F8E8", "FFF3DD"]
_STYLES = (
    '<?xml version="1.0"?><styleSheet xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"><fonts count="3"><font/><font><b/><color rgb="FFFFFFFF"/></font><font><b/></font></fonts>'
    + f'<fills count="{len(_FILLS) + 2}"><fill><patternFill patternType="none"/></fill><fill><patternFill patternType="gray125"/></fill>'
    + "".join(f'<fill><patternFill patternType="solid"><fgColor rgb="FF{c}"/></patternFill></fill>' for c in _FILLS)
    + '</fills><borders count="1"><border/></borders><cellStyleXfs count="1"><xf/></cellStyleXfs><cellXfs count="7"><xf/>'
    + "".join(f'<xf fontId="{(1, 2, 0, 0, 0, 0)[i]}" fillId="{i + 2}" applyFill="1" applyFont="1"/>' for i in range(6))
    + "</cellXfs></styleSheet>"
)


def _letters(i: int) -> str:
    return (chr(64 + i // 26) if i >= 26 else "") + chr(65 + i % 26)


def _row(number: int, cells: list[str], style: int) -> str:
    return f'<row r="{number}">' + "".join(f'<c r="{_letters(i)}{number}" s="{style}" t="inlineStr"><is><t xml:space="preserve">{escape(c)}</t></is></c>' for i, c in enumerate(cells)) + "</row>"


_SHEET = '<?xml version="1.0"?><worksheet xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"><sheetViews><sheetView workbookViewId="0"><pane ySplit="1" topLeftCell="A2" state="frozen"/></sheetView></sheetViews><sheetData>'
_PARTS = (("[Content_Types].xml", _TYPES), ("_rels/.rels", _RELS), ("xl/workbook.xml", _BOOK), ("xl/_rels/workbook.xml.rels", _BOOK_RELS), ("xl/styles.xml", _STYLES))


def write_book(rows: Iterable, file, same: str | None = None) -> int:
    """Export rows as a workbook, header frozen and filtered, streamed into `file`; `same` names a boolean field of same-category rows. The number of rows."""
    styles, n = {"ON": 4, "BC": 5, "YT": 6}, 1
    with zipfile.ZipFile(file, "w", zipfile.ZIP_DEFLATED) as z:
        for name, text in _PARTS:
            z.writestr(name, text)
        with z.open("xl/worksheets/sheet1.xml", "w", force_zip64=True) as sheet:
            sheet.write((_SHEET + _row(1, TITLES, 1)).encode())
            for r in rows:
                n += 1
                style = 2 if r["row_type"] == "ANCHOR" else 3 if same and r[same] else styles.get(r["province"], 0)
                sheet.write(_row(n, [r[c] for c in EXPORT], style).encode())
            sheet.write(f'</sheetData><autoFilter ref="A1:{_letters(len(EXPORT) - 1)}{n}"/></worksheet>'.encode())
    return n - 1


def workbook(rows: DataFrame, same: str | None = None) -> bytes:
    """The export rows of one small result in their given order, as bytes; sources.workbook writes larger ones from tasks."""
    out = io.BytesIO()
    write_book(rows.toLocalIterator(), out, same)
    return out.getvalue()
