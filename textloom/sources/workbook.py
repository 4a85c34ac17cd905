"""Workbooks (Office Open XML) of small result tables, a sheet for each, and the folder rule of exports.

A workbook is one file for a reader, so its tables come to the driver; each is counted first and refused beyond ``MAX_ROWS``,
the format's own limit.
"""

from __future__ import annotations

import io
import os
import re
import zipfile
from xml.sax.saxutils import escape

from pyspark.sql import DataFrame

MAX_ROWS = 1_048_575
_HEAD = '<?xml version="1.0" encoding="UTF-8" standalone="yes"?>'
_MAIN = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"
_REL = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
_PACKAGE = "http://schemas.openxmlformats.org/package/2006"
_KIND = "application/vnd.openxmlformats-officedocument.spreadsheetml"
_BAD = re.compile("[\x00-\x08\x0b\x0c\x0e-\x1f]")


def export_folder(source: str, variable: str) -> str:
    """``<folder of the data>/exports/<file name without ending>_<variable>``."""
    folder, name = os.path.split(source)
    return os.path.join(folder, "exports", f"{os.path.splitext(name)[0]}_{variable}")


def _column(k: int) -> str:
    name = ""
    k += 1
    while k:
        k, rest = divmod(k - 1, 26)
        name = chr(65 + rest) + name
    return name


def _cell(place: str, value) -> str:
    if value is None:
        return ""
    if isinstance(value, bool):
        return f'<c r="{place}" t="b"><v>{int(value)}</v></c>'
    if isinstance(value, (int, float)) and value == value and abs(value) != float("inf"):
        return f'<c r="{place}"><v>{value!r}</v></c>'
    return f'<c r="{place}" t="inlineStr"><is><t xml:space="preserve">{escape(_BAD.sub("", str(value)))}</t></is></c>'


def _sheet(names: list[str], rows) -> str:
    lines = [names, *rows]
    body = "".join(f'<row r="{i}">' + "".join(_cell(f"{_column(k)}{i}", v) for k, v in enumerate(row)) + "</row>" for i, row in enumerate(lines, 1))
    return f'{_HEAD}<worksheet xmlns="{_MAIN}"><sheetData>{body}</sheetData></worksheet>'


def workbook(sheets: dict[str, DataFrame]) -> bytes:
    """The tables as a workbook, in the order given; names of sheets are cut to 31 characters."""
    for name, df in sheets.items():
        if df.limit(MAX_ROWS + 1).count() > MAX_ROWS:
            raise ValueError(f"{name} has more rows than a sheet can hold: write it as CSV")
    parts = {f"xl/worksheets/sheet{i}.xml": _sheet(df.columns, (tuple(r) for r in df.toLocalIterator())) for i, df in enumerate(sheets.values(), 1)}
    titles = "".join(f'<sheet name="{escape(re.sub(r"[:/?*\[\]\\\\]", " ", n)[:31], {chr(34): "&quot;"})}" sheetId="{i}" r:id="rId{i}"/>' for i, n in enumerate(sheets, 1))
    links = "".join(f'<Relationship Id="rId{i}" Type="{_REL}/worksheet" Target="worksheets/sheet{i}.xml"/>' for i in range(1, len(sheets) + 1))
    kinds = "".join(f'<Override PartName="/xl/worksheets/sheet{i}.xml" ContentType="{_KIND}.worksheet+xml"/>' for i in range(1, len(sheets) + 1))
    parts |= {
        "[Content_Types].xml": f'{_HEAD}<Types xmlns="{_PACKAGE}/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Default Extension="xml" ContentType="application/xml"/><Override PartName="/xl/workbook.xml" ContentType="{_KIND}.sheet.main+xml"/>{kinds}</Types>',
        "_rels/.rels": f'{_HEAD}<Relationships xmlns="{_PACKAGE}/relationships"><Relationship Id="rId1" Type="{_REL}/officeDocument" Target="xl/workbook.xml"/></Relationships>',
        "xl/workbook.xml": f'{_HEAD}<workbook xmlns="{_MAIN}" xmlns:r="{_REL}"><sheets>{titles}</sheets></workbook>',
        "xl/_rels/workbook.xml.rels": f'{_HEAD}<Relationships xmlns="{_PACKAGE}/relationships">{links}</Relationships>',
    }
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for name, text in parts.items():
            z.writestr(name, text)
    return out.getvalue()


def write_workbook(sheets: dict[str, DataFrame], path: str) -> None:
    """Writes the workbook wherever Spark can write: to the store that ``path`` names."""
    spark = next(iter(sheets.values())).sparkSession
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    out = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(where, True)
    out.write(bytearray(workbook(sheets)))
    out.close()
