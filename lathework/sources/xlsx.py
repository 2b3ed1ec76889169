"""Spreadsheet files (Office Open XML) without a library: they are ZIP archives of XML.

A worksheet is small (a million rows at most), so it is read in one task per
file, and written by the driver from a bounded table.
"""

from __future__ import annotations

import datetime
import io
import re
import zipfile
from xml.etree import ElementTree as ET
from xml.sax.saxutils import escape

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_MAIN = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
_REL = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}"
MAX_ROWS = 1_048_575
#: Built-in number formats that show dates; fixed values.
_DATE_FORMATS = frozenset([14, 15, 16, 17, 18, 19, 20, 21, 22, 45, 46, 47])


def sheets(data: bytes) -> list[str]:
    """The worksheets' names in order."""
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        return [s.get("name") for s in ET.fromstring(z.read("xl/workbook.xml")).iter(f"{_MAIN}sheet")]


def _column(ref: str) -> int:
    n = 0
    for c in re.match(r"[A-Z]+", ref)[0]:
        n = n * 26 + ord(c) - 64
    return n - 1


def rows(data: bytes, sheet: str | None = None) -> list[list[str | None]]:
    """The cells of a worksheet (the first by default) as text; dates in ISO form."""
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        names = set(z.namelist())
        book = ET.fromstring(z.read("xl/workbook.xml"))
        rels = {r.get("Id"): r.get("Target") for r in ET.fromstring(z.read("xl/_rels/workbook.xml.rels"))}
        wanted = next((s for s in book.iter(f"{_MAIN}sheet") if sheet is None or s.get("name") == sheet), None)
        if wanted is None:
            return []
        target = rels[wanted.get(f"{_REL}id")].lstrip("/")
        target = target if target.startswith("xl/") else f"xl/{target}"
        shared = []
        if "xl/sharedStrings.xml" in names:
            shared = ["".join(t.text or "" for t in si.iter(f"{_MAIN}t")) for si in ET.fromstring(z.read("xl/sharedStrings.xml")).iter(f"{_MAIN}si")]
        dates: set[int] = set()
        if "xl/styles.xml" in names:
            styles = ET.fromstring(z.read("xl/styles.xml"))
            custom = {int(f.get("numFmtId")): f.get("formatCode", "") for f in styles.iter(f"{_MAIN}numFmt")}
            cells = styles.find(f"{_MAIN}cellXfs")
            for i, x in enumerate(cells if cells is not None else []):
                f = int(x.get("numFmtId", "0"))
                if f in _DATE_FORMATS or f in custom and re.search(r"[ymdhs]", re.sub(r'"[^"]*"|\[[^\]]*\]', "", custom[f]), re.I):
                    dates.add(i)
        out: list[list[str | None]] = []
        for row in ET.fromstring(z.read(target)).iter(f"{_MAIN}row"):
            line: list[str | None] = []
            for c in row.iter(f"{_MAIN}c"):
                at = _column(c.get("r")) if c.get("r") else len(line)
                line += [None] * (at + 1 - len(line))
                v, kind = c.find(f"{_MAIN}v"), c.get("t")
                text = None if v is None else v.text
                if kind == "s" and text is not None:
                    text = shared[int(text)]
                elif kind == "inlineStr":
                    text = "".join(t.text or "" for t in c.iter(f"{_MAIN}t"))
                elif kind == "b" and text is not None:
                    text = "TRUE" if text == "1" else "FALSE"
                elif text is not None and int(c.get("s", "0")) in dates:
                    text = serial_text(float(text))
                line[at] = text
            out.append(line)
        return out


def serial_text(serial: float) -> str:
    """A spreadsheet's date number as ISO text."""
    at = datetime.datetime(1899, 12, 30) + datetime.timedelta(days=serial)
    at = (at + datetime.timedelta(microseconds=500_000)).replace(microsecond=0)
    return at.strftime("%Y-%m-%d") if serial == int(serial) else at.strftime("%Y-%m-%d %H:%M:%S")


def read_xlsx(spark: SparkSession, path: str, sheet: str | None = None, order: str = "_row_id") -> DataFrame:
    """One worksheet as text columns under its found header; the file is read by Spark."""
    from .readers import find_header, unique_headers

    data = bytes(spark.read.format("binaryFile").load(path).select("content").first()[0])
    cells = [r for r in rows(data, sheet) if any((c or "").strip() for c in r)]
    found = find_header([[c or "" for c in r] for r in cells])
    width = max((len(r) for r in cells), default=1)
    names = found[1] if found else [f"column_{i + 1}" for i in range(width)]
    names = unique_headers(names + [""] * (width - len(names)))
    body = cells[found[0] + 1 :] if found else cells
    schema = ", ".join(f"`{n}` string" for n in names) + f", {order} long"
    return spark.createDataFrame([(*r, *[None] * (width - len(r)), i) for i, r in enumerate(body)], schema)


def read_all_sheets(spark: SparkSession, path: str) -> DataFrame:
    """Every worksheet, one after the other, with its name in ``excel_worksheetname``."""
    from .readers import combine

    data = bytes(spark.read.format("binaryFile").load(path).select("content").first()[0])
    return combine([(s, read_xlsx(spark, path, s).drop("_row_id")) for s in sheets(data)], "excel_worksheetname")


def workbook(parts: list[tuple[str, list[str], list[tuple]]]) -> bytes:
    """A workbook of (sheet, header, rows): numbers and booleans typed, dates as date cells, all else as text."""

    def cell(v) -> str:
        if v is None:
            return "<c/>"
        if isinstance(v, bool):
            return f'<c t="b"><v>{int(v)}</v></c>'
        if isinstance(v, (int, float)) and (not isinstance(v, int) or abs(v) < 10**15):
            return f"<c><v>{v!r}</v></c>" if v == v and abs(v) != float("inf") else "<c/>"
        if isinstance(v, (datetime.date, datetime.datetime)):
            at = v if isinstance(v, datetime.datetime) else datetime.datetime(v.year, v.month, v.day)
            n = (at.replace(tzinfo=None) - datetime.datetime(1899, 12, 30)) / datetime.timedelta(days=1)
            return f'<c s="{2 if isinstance(v, datetime.datetime) else 1}"><v>{n!r}</v></c>'
        text = re.sub(r"[\x00-\x08\x0b\x0c\x0e-\x1f]", "", str(v))
        return f'<c t="inlineStr"><is><t xml:space="preserve">{escape(text)}</t></is></c>'

    ns = _MAIN.strip("{}")
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        over = "".join(f'<Override PartName="/xl/worksheets/sheet{i + 1}.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.worksheet+xml"/>' for i in range(len(parts)))
        z.writestr("[Content_Types].xml", f'<?xml version="1.0"?><Types xmlns="http://schemas.openxmlformats.org/package/2006/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Override PartName="/xl/workbook.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.sheet.main+xml"/><Override PartName="/xl/styles.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.styles+xml"/>{over}</Types>')
        z.writestr("_rels/.rels", '<?xml version="1.0"?><Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="r" Type="http://schemas.openxmlformats.org/officeDocument/2006/relationships/officeDocument" Target="xl/workbook.xml"/></Relationships>')
        named = "".join(f'<sheet name="{escape(n[:31], {chr(34): "&quot;"})}" sheetId="{i + 1}" r:id="r{i + 1}"/>' for i, (n, _, _) in enumerate(parts))
        z.writestr("xl/workbook.xml", f'<?xml version="1.0"?><workbook xmlns="{ns}" xmlns:r="{_REL.strip("{}")}"><sheets>{named}</sheets></workbook>')
        rels = "".join(f'<Relationship Id="r{i + 1}" Type="http://schemas.openxmlformats.org/officeDocument/2006/relationships/worksheet" Target="worksheets/sheet{i + 1}.xml"/>' for i in range(len(parts)))
        z.writestr("xl/_rels/workbook.xml.rels", f'<?xml version="1.0"?><Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships">{rels}<Relationship Id="s" Type="http://schemas.openxmlformats.org/officeDocument/2006/relationships/styles" Target="styles.xml"/></Relationships>')
        z.writestr("xl/styles.xml", f'<?xml version="1.0"?><styleSheet xmlns="{ns}"><fonts count="1"><font/></fonts><fills count="1"><fill/></fills><borders count="1"><border/></borders><cellStyleXfs count="1"><xf/></cellStyleXfs><cellXfs count="3"><xf numFmtId="0"/><xf numFmtId="14" applyNumberFormat="1"/><xf numFmtId="22" applyNumberFormat="1"/></cellXfs></styleSheet>')
        for i, (_, header, body) in enumerate(parts):
            lines = "".join("<row>" + "".join(map(cell, r)) + "</row>" for r in [header, *body])
            z.writestr(f"xl/worksheets/sheet{i + 1}.xml", f'<?xml version="1.0"?><worksheet xmlns="{ns}"><sheetData>{lines}</sheetData></worksheet>')
    return out.getvalue()


def write_xlsx(df: DataFrame, path: str, sheet: str = "Sheet1", limit: int = MAX_ROWS, text: tuple[str, ...] = ()) -> None:
    """At most ``limit`` rows (a worksheet's own bound) as one file; ``text`` columns stay text."""
    df = df.select(*[F.col(f"`{c}`").cast("string").alias(c) if c in text else F.col(f"`{c}`") for c in df.columns]).limit(min(limit, MAX_ROWS))
    with open(path, "wb") as f:
        f.write(workbook([(sheet, df.columns, [tuple(r) for r in df.toLocalIterator()])]))
