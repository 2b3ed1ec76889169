"""Reading messy files: delimiter, encoding, header and footer found on the head, the body read by Spark.

Only a bounded head (``HEAD_BYTES``) reaches the driver, through Spark's own
reader, so any file system that Spark reads will do.
"""

from __future__ import annotations

import bz2
import io
import re
import zipfile
import zlib
from collections import Counter
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

HEAD_BYTES = 256 * 1024
DELIMITERS = (",", "\t", ";", "|")
_NUMBER = re.compile(r"^[-+(]?[$€£]?\d[\d,. ]*%?\)?$")


def head(spark: SparkSession, path: str, n: int = HEAD_BYTES) -> bytes:
    """The first bytes of a file (of a folder or pattern: of its first file), through Spark's file systems; no more is read.

    What gzip or bzip2 has packed is unpacked.
    """
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    fs = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    found = sorted((f for f in fs.globStatus(at) or ()), key=lambda f: f.getPath().toString())
    while found and found[0].isDirectory():
        inner = [f for f in fs.listStatus(found[0].getPath()) if not f.getPath().getName().startswith(("_", "."))]
        found = sorted(inner, key=lambda f: f.getPath().toString())
    if not found:
        return b""
    stream = fs.open(found[0].getPath())
    try:
        data = bytes(stream.readNBytes(n))
    finally:
        stream.close()
    if data.startswith(b"\x1f\x8b"):
        return zlib.decompressobj(31).decompress(data, n)
    if data.startswith(b"BZh"):
        return bz2.BZ2Decompressor().decompress(data, n)
    return data


def sniff_encoding(data: bytes) -> str:
    """UTF-32 and UTF-16 by mark or zero bytes, else UTF-8 when it decodes, else windows-1252."""
    for mark, name in ((b"\xff\xfe\x00\x00", "UTF-32LE"), (b"\x00\x00\xfe\xff", "UTF-32BE"), (b"\xff\xfe", "UTF-16LE"), (b"\xfe\xff", "UTF-16BE"), (b"\xef\xbb\xbf", "UTF-8")):
        if data.startswith(mark):
            return name
    some = data[:4000]
    if len(some) >= 8:
        even, odd = some[::2].count(0) / (len(some) / 2), some[1::2].count(0) / (len(some) / 2)
        if odd > 0.4 > even:
            return "UTF-16LE"
        if even > 0.4 > odd:
            return "UTF-16BE"
    try:
        data[: len(data) - 4 if len(data) >= HEAD_BYTES else len(data)].decode("utf-8")
        return "UTF-8"
    except UnicodeDecodeError:
        text = data.decode("utf-8", "replace")
        bad, good = text.count("�"), sum(ord(c) > 127 for c in text)
        return "UTF-8" if good - bad >= 5 * max(1, bad) else "windows-1252"


def split_line(line: str, delimiter: str) -> list[str]:
    import csv

    return next(csv.reader([line], delimiter=delimiter), [])


def sniff_delimiter(text: str) -> str:
    """The sign whose field counts are large and steady over the first ten lines."""
    lines = [x for x in text.splitlines() if x.strip()][:10]
    best = (0.0, ",")
    for d in DELIMITERS:
        counts = [len(split_line(x, d)) for x in lines]
        if not counts:
            continue
        mode, n = Counter(counts).most_common(1)[0]
        if mode > 1:
            best = max(best, (mode * 10 * n / len(counts) + n, d), key=lambda x: x[0])
    return best[1]


def find_header(rows: list[list[str]]) -> tuple[int, list[str]] | None:
    """The header's row and names among the first 25 rows; None for a headerless table.

    A header is wide, textual and stands above rows more numeric than itself.
    """
    rows = rows[:25]
    if not rows:
        return None
    width = max(len(r) for r in rows)

    def share(r: list[str], test) -> float:
        return sum(map(test, r)) / max(1, len(r))

    number = lambda c: bool(_NUMBER.match(c.strip()))
    texty = lambda c: bool(c.strip()) and not number(c)
    best = None
    for i, r in enumerate(rows[:-1] if len(rows) > 1 else rows):
        below = rows[i + 1 : i + 6]
        under = sum(share(b, number) for b in below) / max(1, len(below))
        points = 2 * share(r, texty) + 2 * (sum(bool(c.strip()) for c in r) / width) + 3 * under - 3 * share(r, number)
        if points >= 2.5 and (best is None or points > best[0] + 1e-9):
            best = (points, i)
    if best is None or share(rows[best[1]], number) >= 0.5:
        return None
    return best[1], unique_headers(rows[best[1]])


_UNIT = re.compile(r"^[(\[]?(%|°[CF]?|[$€£]|[A-Za-zµ]{1,5}([/²³^][A-Za-z0-9²³]{0,5})?)[)\]]?$")


def merged_header(rows: list[list[str]], at: int, names: list[str]) -> tuple[int, list[str]]:
    """The header with a super-header above it and a row of units below it: (last header row, names).

    A super-header has two texts or more and leaves gaps that its texts span; a
    units row is short signs only, above numbers.
    """
    width = len(names)
    plain = [c.strip() for c in rows[at]] + [""] * (width - len(rows[at]))
    if at > 0:
        above = [c.strip() for c in rows[at - 1]] + [""] * (width - len(rows[at - 1]))
        full = [c for c in above if c]
        if len(full) >= 2 and len(full) < sum(bool(c) for c in plain) and not any(_NUMBER.match(c) for c in full):
            span, merged = "", []
            for top, low in zip(above, plain):
                span = top or span
                merged.append(f"{span} {low}".strip() if span != low else low)
            plain = merged
    last = at
    if at + 2 < len(rows):
        units = [c.strip() for c in rows[at + 1]] + [""] * (width - len(rows[at + 1]))
        below = rows[at + 2]
        numeric = sum(bool(_NUMBER.match(c.strip())) for c in below)
        if any(units) and numeric and all(not u or _UNIT.match(u) for u in units) and sum(map(bool, units)) >= max(1, numeric // 2):
            plain = [f"{n} ({u.strip('()[]')})" if u else n for n, u in zip(plain, units)]
            last = at + 1
    return last, unique_headers(plain[:width])


def footer(columns: list[str]) -> Column:
    """Whether a row looks like a note, a source line or a total."""
    first = F.lower(F.trim(F.coalesce(*[F.when(F.trim(F.col(f"`{c}`")) != "", F.col(f"`{c}`")) for c in columns], F.lit(""))))
    filled = sum((F.coalesce(F.trim(F.col(f"`{c}`")) != "", F.lit(False)).cast("int") for c in columns), F.lit(0))
    note = first.rlike(r"^(notes?\b|sources?\b|\*|©|generated\b|last updated)") & (filled <= max(1, len(columns) // 3))
    return note | first.rlike(r"^(grand )?totals?\b")


def without_footer(df: DataFrame, columns: list[str], order: str) -> DataFrame:
    """The rows up to the last one that is not a footer."""
    last = df.where(~footer(columns)).agg(F.max(order).alias("_last"))
    return df.join(F.broadcast(last)).where(F.col(order) <= F.col("_last")).drop("_last")


def unique_headers(names: list[str]) -> list[str]:
    """Blank names become ``column_n``; repeated ones get ``(2)``."""
    out: list[str] = []
    for i, n in enumerate(names):
        n = n.strip() or f"column_{i + 1}"
        base, k = n, 2
        while n.lower() in {x.lower() for x in out}:
            n, k = f"{base} ({k})", k + 1
        out.append(n)
    return out


def _cuts(delimiter: str) -> tuple[str, str]:
    """Patterns of an opening quote that its line never closes, and of a whole quoted cell."""
    d = re.escape(delimiter)
    return rf'(^|{d})"(?=[^"]*$)', r'"(?:[^"]|"")*"'


def repair_line(line: str, delimiter: str) -> str:
    """A line without the opening quote that it never closes."""
    return re.sub(_cuts(delimiter)[0], r"\1", line) if line.count('"') % 2 else line


def stray_quotes(lines: list[str], delimiter: str) -> bool:
    """Whether lines with an odd number of quotes hold stray ones, not cells with line breaks: without them each is a whole row."""
    odd = [x for x in lines if x.count('"') % 2]
    counts = Counter(len(split_line(x, delimiter)) for x in lines if x.strip() and x.count('"') % 2 == 0)
    return bool(odd and counts) and all(len(split_line(repair_line(x, delimiter), delimiter)) >= counts.most_common(1)[0][0] for x in odd)


@dataclass
class Layout:
    """How a delimited file is laid out, from its head."""

    encoding: str
    delimiter: str
    names: list[str]
    skip: int  # the header's record; -1 without a header
    multiline: bool


def layout_of(spark: SparkSession, path: str, delimiter: str | None = None, encoding: str | None = None, header: bool | None = None) -> Layout:
    import csv

    data = head(spark, path)
    encoding = encoding or sniff_encoding(data)
    text = data.decode({"windows-1252": "cp1252"}.get(encoding, encoding), "replace").lstrip("\ufeff")
    delimiter = delimiter or sniff_delimiter(text)
    physical = text.splitlines()
    if stray_quotes(physical[:200], delimiter):
        text = "\n".join(repair_line(x, delimiter) for x in physical)
    lines = [r for r in csv.reader(io.StringIO(text), delimiter=delimiter) if r][:60]
    rows = [r for r in lines if any(c.strip() for c in r)][:30]
    found = find_header(rows) if header is not False else None
    if header and found is None and rows:
        found = (0, unique_headers(rows[0]))
    elif found:
        found = merged_header(rows, *found)
    width = len(found[1]) if found else max((len(r) for r in rows), default=1)
    names = found[1] if found else [f"column_{i + 1}" for i in range(width)]
    return Layout(encoding, delimiter, names, lines.index(rows[found[0]]) if found else -1, any("\n" in c for r in lines for c in r))


def read_delimited(spark: SparkSession, path: str, delimiter: str | None = None, encoding: str | None = None, header: bool | None = None, order: str = "_row_id", cut_footer: bool = True, limit: int | None = None) -> DataFrame:
    """All cells as text under found or given layout, with a row number column.

    Rows are padded or cut to the header's width (``ragged`` counts them).  A
    quote that its line never closes is dropped, unless cells have line breaks.
    The row number follows the file order: partition index first, then the place
    in the partition.
    """
    at = layout_of(spark, path, delimiter, encoding, header)
    schema = T.StructType([T.StructField(f"_c{i}", T.StringType()) for i in range(len(at.names))])
    # Cells with line breaks keep a file in one task; without any in the head it is read line by line, in splits.
    if at.multiline or at.encoding not in ("utf-8", "utf-8-sig", "ascii", "UTF-8"):
        body = spark.read.schema(schema).csv(path, sep=at.delimiter, header=False, multiLine=at.multiline, quote='"', escape='"', encoding="ISO-8859-1" if at.encoding == "windows-1252" else at.encoding, mode="PERMISSIVE", ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False, enforceSchema=True)
    else:
        line = F.regexp_replace("value", "^\ufeff", "")
        whole = F.when(F.length(F.regexp_replace(line, '[^"]', "")) % 2 == 1, F.regexp_replace(line, _cuts(at.delimiter)[0], "$1")).otherwise(line)
        options = {"sep": at.delimiter, "quote": '"', "escape": '"', "mode": "PERMISSIVE", "ignoreLeadingWhiteSpace": "false", "ignoreTrailingWhiteSpace": "false"}
        lines = spark.read.text(path).where(F.trim("value") != "")
        body = lines.select(F.from_csv(whole, schema.simpleString().removeprefix("struct<").removesuffix(">").replace(":", " "), options).alias("r")).select("r.*")
    numbered = body.withColumn(order, F.monotonically_increasing_id())
    if at.skip >= 0:
        # Titles and header are the first records of the file, and so the first row numbers.
        numbered = numbered.where(F.col(order) > F.lit(at.skip))
    cells = numbered.select(*[F.col(f"_c{i}").alias(n) for i, n in enumerate(at.names)], order)
    empty = F.lit(True)
    for n in at.names:
        empty = empty & (F.trim(F.coalesce(F.col(f"`{n}`"), F.lit(""))) == "")
    out = cells.where(~empty)
    if cut_footer and at.skip >= 0:
        out = without_footer(out, at.names, order)
    return out.orderBy(order).limit(limit) if limit is not None else out


def ragged(spark: SparkSession, path: str, delimiter: str | None = None, header: bool | None = None) -> DataFrame:
    """One row: lines of a delimited file, short ones (padded), long ones (cut), the filled cells that these lose, lines with a stray quote.

    For files whose cells have no line breaks.
    """
    at = layout_of(spark, path, delimiter, None, header)
    width = len(at.names)
    value = F.col("value")
    odd = F.length(F.regexp_replace(value, '[^"]', "")) % 2 == 1
    stray, cell = _cuts(at.delimiter)
    whole = F.when(odd, F.regexp_replace(value, stray, "$1")).otherwise(value)
    parts = F.split(F.regexp_replace(whole, cell, "q"), re.escape(at.delimiter), -1)
    rows = spark.read.text(path).where(F.trim("value") != "").select(F.size(parts).alias("n"), (odd & (whole != value)).alias("stray"), F.when(F.size(parts) > width, F.size(F.filter(F.slice(parts, width + 1, F.size(parts)), lambda x: F.trim(x) != ""))).otherwise(0).alias("extra"))
    return rows.agg(
        F.count(F.lit(1)).alias("lines"), F.count_if(F.col("n") < width).alias("padded"), F.count_if(F.col("extra") > 0).alias("cut"), F.coalesce(F.sum("extra"), F.lit(0)).alias("lost_cells"), F.count_if("stray").alias("stray_quotes")
    )


def flatten(df: DataFrame) -> DataFrame:
    """Structs to dotted columns, arrays and maps to JSON text."""
    while True:
        out, deeper = [], False
        for f in df.schema:
            c = F.col(f"`{f.name}`")
            if isinstance(f.dataType, T.StructType):
                deeper = True
                out += [c[g.name].alias(f"{f.name}.{g.name}") for g in f.dataType]
            elif isinstance(f.dataType, (T.ArrayType, T.MapType)):
                out.append(F.to_json(c).alias(f.name))
            else:
                out.append(c)
        df = df.select(*out)
        if not deeper:
            return df


def read_json(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    """JSON documents or lines, flattened."""
    return flatten(spark.read.json(path, multiLine=not lines))


def read_parquet(spark: SparkSession, path: str) -> DataFrame:
    """Flat columns keep their types; nested ones become JSON text."""
    return flatten(spark.read.parquet(path))


def read_zip(spark: SparkSession, path: str, suffixes: tuple[str, ...] = (".csv", ".tsv", ".txt", ".json", ".jsonl")) -> DataFrame:
    """The text members of ZIP archives: archive, member, text."""

    def members(batches):
        import pandas as pd

        for pdf in batches:
            rows = []
            for where, content in zip(pdf["path"], pdf["content"], strict=True):
                with zipfile.ZipFile(io.BytesIO(content)) as z:
                    for n in z.namelist():
                        if n.lower().endswith(suffixes):
                            raw = z.read(n)
                            rows.append((where, n, raw.decode({"windows-1252": "cp1252"}.get(sniff_encoding(raw), sniff_encoding(raw)), "replace")))
            yield pd.DataFrame(rows, columns=["archive", "member", "text"])

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(members, "archive string, member string, text string")


def read_geojson(spark: SparkSession, path: str) -> list[tuple[str, list[list[tuple[float, float]]]]]:
    """Polygons as (name, rings); a boundary file is small and is meant to be held."""
    import json

    out = []
    data = json.loads(head(spark, path, 64 << 20))
    for f in data.get("features", []):
        g = f.get("geometry") or {}
        polys = [g["coordinates"]] if g.get("type") == "Polygon" else g.get("coordinates", []) if g.get("type") == "MultiPolygon" else []
        props = f.get("properties") or {}
        name = str(props.get("name") or f.get("id") or next(iter(props.values()), len(out)))
        out.append((name, [[(float(x), float(y)) for x, y, *_ in ring] for p in polys for ring in p]))
    return out


def looks_binary(data: bytes) -> bool:
    """Not a table: known magic numbers, NULs or many control characters."""
    if data[:4] in (b"\x89PNG", b"%PDF", b"\xff\xd8\xff\xe0", b"GIF8", b"\x7fELF") or data[:2] == b"MZ":
        return True
    some = data[:2000]
    return sniff_encoding(data) == "UTF-8" and (some.count(0) > 0 or sum(b < 9 or 13 < b < 32 for b in some) > 0.1 * max(1, len(some)))


def combine(parts: list[tuple[str, DataFrame]], column: str = "_input_filename") -> DataFrame:
    """Tables (or worksheets) one after the other with their name in a column."""
    from ..operators.transforms import append

    out = append([df for _, df in parts], [n for n, _ in parts])
    return out.withColumnRenamed("_input_filename", column)


def row_ids(df: DataFrame, order: list[str], name: str = "_row_id") -> DataFrame:
    """A dense row number from 0 in a natural key's order, without sorting in one task."""
    from ..operators.order import row_number

    out = row_number(df, order[0], name, tuple(order[1:]))
    return out.withColumn(name, F.col(name) - 1)


def infer_types(df: DataFrame, columns: list[str] | None = None, sample: int = 1000) -> dict[str, str]:
    """Logical types of text columns from a bounded sample of rows: one aggregation of shape counts."""
    columns = columns or df.columns
    some = df.limit(sample)
    from ..functions import cleans

    aggs = []
    for c in columns:
        s = F.trim(F.col(f"`{c}`").cast("string"))
        ok = ~cleans.is_missing(s)
        count: list[Column] = [
            F.count_if(ok).alias("n"),
            F.count_if(ok & F.lower(s).isin("true", "false", "yes", "no", "y", "n", "t", "f")).alias("boolean"),
            F.count_if(ok & s.rlike(r"^0\d+$")).alias("leading"),
            F.count_if(ok & s.rlike(r"^[+-]?\d{1,15}(\.0+)?$")).alias("integer"),
            F.count_if(ok & cleans.number(s).isNotNull()).alias("number"),
            F.count_if(ok & cleans.to_date(s).isNotNull()).alias("date"),
            F.count_if(ok & s.rlike(r"\d{1,2}:\d{2}") & s.try_cast("timestamp_ntz").isNotNull()).alias("datetime"),
            F.count_if(ok & s.rlike(r"^\d{1,2}:\d{2}(:\d{2})?$")).alias("time"),
            F.countDistinct(F.when(ok, s)).alias("distinct"),
        ]
        aggs.append(F.struct(*count).alias(f"`{c}`".strip("`")))
    row = some.agg(*aggs).first()
    out = {}
    for c in columns:
        r = row[c]
        n = r["n"]
        if not n:
            out[c] = "string"
        elif r["boolean"] == n:
            out[c] = "boolean"
        elif r["leading"] > 0.05 * n and r["integer"] >= 0.95 * n:
            out[c] = "identifier"
        elif r["integer"] >= 0.95 * n:
            out[c] = "integer"
        elif r["number"] >= 0.95 * n:
            out[c] = "number"
        elif r["time"] >= 0.95 * n:
            out[c] = "time"
        elif r["datetime"] >= 0.8 * n:
            out[c] = "datetime"
        elif r["date"] >= 0.8 * n:
            out[c] = "date"
        elif r["distinct"] <= 12 or r["distinct"] <= 200 and n >= 5 * r["distinct"]:
            out[c] = "category"
        else:
            out[c] = "string"
    return out


def typed(df: DataFrame, types: dict[str, str]) -> DataFrame:
    """Text columns as their logical types; what does not parse is null."""
    from ..functions import cleans

    how = {"integer": "integer", "number": "number", "boolean": "boolean", "date": "date", "datetime": "datetime"}
    for c, t in types.items():
        if t in how:
            df = df.withColumn(c, F.when(~cleans.is_missing(F.col(f"`{c}`")), cleans.cast(F.col(f"`{c}`"), how[t])))
        elif t in ("time", "duration"):
            df = df.withColumn(c, cleans.duration_ms(F.col(f"`{c}`")))
    return df
