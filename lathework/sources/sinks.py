"""Writing tables: delimited, JSON, Parquet and ORC, with masking, exclusion and formula escape."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import cleans

FORMATS = {"csv": ("csv", ","), "csv-semicolon": ("csv", ";"), "tsv": ("csv", "\t"), "json": ("json", None), "jsonl": ("json", None), "parquet": ("parquet", None), "orc": ("orc", None)}


def canonical(df: DataFrame, null_as_blank: bool = True, escape: bool = False) -> DataFrame:
    """Every cell as export text: ISO dates, plain numbers, blanks for nulls."""
    out = []
    for f in df.schema:
        c, t = F.col(f"`{f.name}`"), f.dataType.simpleString()
        if t in ("float", "double"):
            whole = (c == F.floor(c)) & (F.abs(c) < 1e15)
            c = F.when(whole, c.cast("bigint").cast("string")).otherwise(c.cast("string"))
        elif t.startswith("timestamp"):
            c = F.regexp_replace(F.date_format(c, "yyyy-MM-dd HH:mm:ss"), " 00:00:00$", "")
        else:
            c = c.cast("string")
            if escape and t == "string":
                c = cleans.escape_formulas(c)
        out.append((F.coalesce(c, F.lit("")) if null_as_blank else c).alias(f.name))
    return df.select(*out)


def write(df: DataFrame, path: str, kind: str = "csv", compression: str | None = None, exclude: tuple[str, ...] = (), mask: dict[str, tuple[int, int]] | None = None, escape: bool = False, limit: int | None = None, mode: str = "overwrite") -> None:
    """Write ``df``; ``mask`` hides all but the first and last characters of a column; ``limit`` keeps the first rows."""
    fmt, sep = FORMATS[kind]
    df = df.drop(*exclude)
    for c, (first, last) in (mask or {}).items():
        df = df.withColumn(c, cleans.mask(F.col(c).cast("string"), first, last))
    if limit is not None:
        df = df.limit(limit)
    if fmt == "csv":
        w = canonical(df, escape=escape).write.mode(mode).option("header", True).option("sep", sep).option("lineSep", "\r\n").option("emptyValue", "").option("escape", '"')
    else:
        w = df.write.mode(mode)
    if compression:
        w = w.option("compression", compression)
    w.format(fmt).save(path)


def markdown(rows: list[dict]) -> str:
    """A bounded report (rules, score) as a Markdown table."""
    if not rows:
        return ""
    names = list(rows[0])
    lines = ["| " + " | ".join(names) + " |", "|" + "-|" * len(names)]
    lines += ["| " + " | ".join(str(r[n]) for n in names) + " |" for r in rows]
    return "\n".join(lines) + "\n"


def checks_sodacl(table: str, rules: list) -> str:
    """Rules as SodaCL."""
    out = [f"checks for {table}:"]
    for r in rules:
        if r.kind == "notNull":
            out.append(f"  - missing_count({r.column}) = 0")
        elif r.kind == "unique":
            out.append(f"  - duplicate_count({r.column}) = 0")
        elif r.kind == "range":
            out.append(f"  - invalid_count({r.column}) = 0:\n      valid min: {r.low}\n      valid max: {r.high}")
        elif r.kind == "inList":
            out.append(f"  - invalid_count({r.column}) = 0:\n      valid values: [{', '.join(r.values)}]")
        elif r.kind == "regex":
            out.append(f"  - invalid_count({r.column}) = 0:\n      valid regex: {r.pattern}")
    return "\n".join(out) + "\n"


def checks_dbt(table: str, rules: list) -> str:
    """Rules as dbt tests."""
    out = ["version: 2", "models:", f"  - name: {table}", "    columns:"]
    by: dict[str, list[str]] = {}
    for r in rules:
        tests = by.setdefault(r.column, [])
        if r.kind == "notNull":
            tests.append("not_null")
        elif r.kind == "unique":
            tests.append("unique")
        elif r.kind == "inList":
            tests.append("accepted_values:\n              values: [" + ", ".join(f"'{v}'" for v in r.values) + "]")
    for c, tests in by.items():
        out.append(f"      - name: {c}\n        tests:")
        out += [f"          - {t}" for t in tests]
    return "\n".join(out) + "\n"
