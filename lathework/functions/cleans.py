"""Value cleans: Column to Column, null in, null out."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Texts that stand for a missing value, after trimming and lower-casing; fixed values.
NULL_TOKENS = (
    "", "-", "--", "---", "----", "—", "–", "?", "??", "???", "...", "…", "####", "null", "nil", "none", "nan", "na", "n/a", "n.a", "n.a.", "#n/a",
    "undefined", "missing", "unknown", "unspecified", "tbd", "tba", "empty", "blank", "(empty)", "(blank)", "(null)", "[empty]", "[blank]", "[null]",
    "<na>", "<null>", "<none>", "not available", "not applicable", "not provided", "not specified", "no data", "no value", "no answer", "no response",
    "null value", "none supplied", "\\n", "#value!", "#div/0!", "#ref!", "#name?", "#num!", "#null!", "#error!", "error", "#error",
)
#: What is left of them without punctuation and spacing; fixed values.
COMPACT_TOKENS = (
    "na", "null", "nil", "none", "nan", "undefined", "missing", "unknown", "unspecified", "tbd", "tba", "empty", "blank", "notavailable", "notapplicable",
    "notprovided", "notspecified", "nodata", "novalue", "noanswer", "noresponse", "nullvalue", "nonesupplied", "error",
)


def plain_cell(c: Column) -> Column:
    """A raw cell in lower case without white space and invisible marks at its ends."""
    return F.lower(F.regexp_replace(c.cast("string"), r"^[\s\u200b-\u200d\u2060\ufeff]+|[\s\u200b-\u200d\u2060\ufeff]+$", ""))


def is_missing(c: Column, extra: tuple[str, ...] = (), keep: tuple[str, ...] = (), plain: Column | None = None) -> Column:
    """Whether a raw cell is missing: ``keep`` (exact) beats ``extra`` (exact) beats the tokens.

    ``plain``: a column that holds ``plain_cell(c)`` already.
    """
    text = c.cast("string")
    plain = plain_cell(c) if plain is None else plain
    # "N / A", "N.A." and "<NA>" are one token; a digit or a long text is none.
    compact = F.regexp_replace(plain, r"[^\p{L}\p{N}]", "")
    token = plain.isin(*NULL_TOKENS) | (F.char_length(plain) <= 24) & compact.isin(*COMPACT_TOKENS)
    out = text.isNull() | token
    if extra:
        out = F.when(text.isin(*extra), True).otherwise(out)
    if keep:
        out = F.when(text.isin(*keep), False).otherwise(out)
    return F.coalesce(out, F.lit(True))


def trim(c: Column) -> Column:
    return F.trim(F.regexp_replace(c, r"\s+", " "))


def case(c: Column, how: str) -> Column:
    return {"upper": F.upper, "lower": F.lower, "title": F.initcap}[how](c)


def replace(c: Column, old: str, new: str, ignore_case: bool = False) -> Column:
    if ignore_case:
        return F.regexp_replace(c, "(?i)\\Q" + old + "\\E", new)
    return F.replace(c, F.lit(old), F.lit(new))


def number(c: Column, comma: bool = False) -> Column:
    """The number in a text: grouping checked, currency and percent signs dropped, parentheses negative; else null."""
    text = F.trim(c.cast("string"))
    negative = text.rlike(r"^\(.*\)$")
    body = F.regexp_replace(F.regexp_replace(text, r"^\((.*)\)$", "$1"), r"[$€£¥%\s]", "")
    group, mark = (r"\.", ",") if comma else (",", r"\.")
    shape = rf"^[+-]?(\d+|\d{{1,3}}({group}\d{{3}})+)?({mark}\d+)?([eE][+-]?\d+)?$"
    plain = F.regexp_replace(body, group, "")
    if comma:
        plain = F.replace(plain, F.lit(","), F.lit("."))
    value = F.when(body.rlike(shape) & body.rlike(r"\d"), plain.try_cast("double"))
    return value * F.when(negative, -1.0).otherwise(1.0)


def repair_decimal(c: Column, comma: bool = False) -> Column:
    """Numbers written with the other decimal mark rewritten with a point; the column's own way (``comma``) stays as it is.

    Only a value that cannot be read the column's own way is rewritten: one mark
    with other than three digits after it, or both marks in the other order.
    """
    text = F.trim(c.cast("string"))
    group, mark = (r"\.", ",") if comma else (",", r"\.")
    # The other way: ``group`` is the decimal mark and ``mark`` groups thousands.
    other = text.rlike(rf"^[+-]?\d{{1,3}}({mark}\d{{3}})+{group}\d+$") | text.rlike(rf"^[+-]?\d+{group}(\d{{1,2}}|\d{{4,}})$")
    plain = F.regexp_replace(F.regexp_replace(text, mark, ""), group, ".")
    return F.when(other, plain).otherwise(c)


def set_cells(c: Column, order: Column, edits: dict) -> Column:
    """Single cells set by the row's order value."""
    out = c.cast("string")
    for row, value in edits.items():
        out = F.when(order == F.lit(row), F.lit(value)).otherwise(out)
    return out


def to_number(c: Column, comma: bool = False) -> Column:
    """Canonical number text, or the text unchanged."""
    n = number(c, comma)
    whole = (n == F.floor(n)) & (F.abs(n) < 1e15)
    return F.when(n.isNull(), c).when(whole, n.cast("bigint").cast("string")).otherwise(n.cast("string"))


def sign_suffix(c: Column) -> Column:
    """``120 DR`` to -120 and ``120 CR`` to 120."""
    m = F.regexp_extract(c, r"(?i)^\s*([\d.,]+)\s*(DR|CR)\.?\s*$", 1)
    side = F.lower(F.regexp_extract(c, r"(?i)^\s*([\d.,]+)\s*(DR|CR)\.?\s*$", 2))
    return F.when(side == "dr", F.concat(F.lit("-"), m)).when(side == "cr", m).otherwise(c)


def escape_formulas(c: Column) -> Column:
    """A quote before a text that a spreadsheet would run."""
    risky = c.rlike(r"^[=@\t\r]") | (c.rlike(r"^[+-]") & ~c.rlike(r"^[+-]?[\d.,]+%?$"))
    return F.when(risky, F.concat(F.lit("'"), c)).otherwise(c)


def keep_numbers(c: Column) -> Column:
    return F.regexp_extract(c, r"[-+]?\d[\d,]*(?:\.\d+)?", 0)


def keep_text(c: Column) -> Column:
    return trim(F.regexp_replace(c, r"[^\p{L}\s'-]", " "))


def mask(c: Column, first: int = 0, last: int = 0, sign: str = "*") -> Column:
    n = F.char_length(c)
    hidden = F.greatest(n - (first + last), F.lit(0))
    return F.when(hidden > 0, F.concat(F.left(c, F.lit(first)), F.repeat(F.lit(sign), hidden), F.right(c, F.lit(last)))).otherwise(F.repeat(F.lit(sign), n))


def hashed(c: Column, salt: str) -> Column:
    """The first 16 hex digits of SHA-256 over salt, NUL and the trimmed text."""
    return F.substring(F.sha2(F.concat(F.lit(salt), F.chr(F.lit(0)), F.trim(c)), 256), 1, 16)


def recode(c: Column, mapping: dict[str, str]) -> Column:
    pairs = [x for k, v in mapping.items() for x in (F.lit(k), F.lit(v))]
    return F.coalesce(F.create_map(*pairs)[F.trim(c)], c) if pairs else c


#: Layouts tried in order for day-first and month-first reading; fixed values.
_ISO = ("yyyy-MM-dd", "yyyy/MM/dd", "yyyyMMdd")
_DAY_FIRST = ("d/M/yyyy", "d-M-yyyy", "d.M.yyyy", "d MMM yyyy", "d MMMM yyyy")
_MONTH_FIRST = ("M/d/yyyy", "M-d-yyyy", "MMM d, yyyy", "MMMM d, yyyy")


def to_date(c: Column, order: str = "dmy") -> Column:
    """A date from text: ISO first, then day-first (``dmy``) or month-first (``mdy``) layouts, or ``fmt:<moment pattern>``."""
    text = F.trim(c.cast("string"))
    if order.startswith("fmt:"):
        return F.try_to_timestamp(text, F.lit(moment_pattern(order[4:]))).cast("date")
    shapes = {"yyyy-MM-dd": r"^\d{4}-\d{2}-\d{2}$", "yyyy/MM/dd": r"^\d{4}/\d{2}/\d{2}$", "yyyyMMdd": r"^(19|20)\d{6}$"}
    out = F.lit(None).cast("date")
    for p in (*_ISO, *(_DAY_FIRST if order == "dmy" else _MONTH_FIRST)):
        one = F.try_to_timestamp(text, F.lit(p)).cast("date")
        out = F.coalesce(out, F.when(text.rlike(shapes[p]), one) if p in shapes else one)
    return out


def moment_pattern(p: str) -> str:
    """YYYY MM DD HH hh mm ss A tokens as a Java pattern."""
    out = re.sub(r"\[([^\]]*)\]", lambda m: "'" + m[1] + "'", p)
    for a, b in (("YYYY", "yyyy"), ("YY", "yy"), ("DD", "dd"), ("D", "d"), ("dddd", "EEEE"), ("A", "a")):
        out = out.replace(a, b)
    return out


def number_to_date(c: Column, kind: str) -> Column:
    """excelSerial, epochSeconds, epochMillis or yyyymmdd, within sensible ranges."""
    n = c.cast("double")
    if kind == "excelSerial":
        return F.when((n >= 1) & (n < 2958466), F.date_add(F.lit("1899-12-30").cast("date"), F.floor(n).cast("int")))
    if kind == "epochSeconds":
        return F.when(F.abs(n) < 4102444800, F.timestamp_seconds(n)).cast("date")
    if kind == "epochMillis":
        return F.when(F.abs(n) < 4102444800000, F.timestamp_millis(n.cast("bigint"))).cast("date")
    text = n.cast("bigint").cast("string")
    return F.when(text.rlike(r"^(18|19|20)\d{6}$"), F.try_to_timestamp(text, F.lit("yyyyMMdd")).cast("date"))


def loses_digits(c: Column) -> Column:
    """Whether a number would change the text's digits: leading zeros, or more digits than a double holds."""
    return F.trim(c.cast("string")).rlike(r"^[+-]?0\d|^[+-]?\d{16,}$")


def clock_ms(c: Column) -> Column:
    """``H:MM``, ``H:MM:SS.mmm``, with or without am and pm, to milliseconds of the day; else null."""
    text = F.trim(c.cast("string"))
    shape = r"(?i)^(\d{1,2}):(\d{2})(?::(\d{2})(?:\.(\d{1,3}))?)?\s*(?:([ap])\.?m\.?)?$"
    part = lambda i: F.regexp_extract(text, shape, i)
    hour, minute, second = part(1).try_cast("int"), part(2).try_cast("int"), F.coalesce(part(3).try_cast("int"), F.lit(0))
    half = F.lower(part(5))
    hour = F.when(half == "", hour).when(~hour.between(1, 12), None).when((half == "p") & (hour != 12), hour + 12).when((half == "a") & (hour == 12), 0).otherwise(hour)
    milli = F.coalesce(F.rpad(part(4), 3, "0").try_cast("int"), F.lit(0))
    return F.when(text.rlike(shape) & (hour <= 23) & (minute <= 59) & (second <= 59), ((hour * 60 + minute) * 60 + second).cast("long") * 1000 + milli)


#: Milliseconds of a unit of elapsed time by its first letter; fixed values.
UNIT_MS = {"d": 86_400_000, "h": 3_600_000, "m": 60_000, "s": 1_000}


def elapsed_ms(c: Column) -> Column:
    """``H:MM:SS`` (any number of hours) or units (``1h 30m``, ``2 days``) to milliseconds; else null."""
    text = F.trim(c.cast("string"))
    clock = r"^(\d{1,9}):([0-5]\d):([0-5]\d)(?:\.(\d{1,3}))?$"
    part = lambda i: F.coalesce(F.regexp_extract(text, clock, i).try_cast("long"), F.lit(0))
    unit = r"(?i)(\d+(?:\.\d+)?)\s*(days?|d|hours?|hrs?|h|minutes?|mins?|m|seconds?|secs?|s)"
    amounts, names = F.regexp_extract_all(text, F.lit(unit), F.lit(1)), F.regexp_extract_all(text, F.lit(unit), F.lit(2))
    each = F.transform(F.arrays_zip(amounts.alias("a"), names.alias("u")), lambda p: p["a"].cast("double") * F.create_map(*[x for k, v in UNIT_MS.items() for x in (F.lit(k), F.lit(float(v)))])[F.lower(F.left(p["u"], F.lit(1)))])
    rest = F.regexp_replace(F.regexp_replace(text, unit, ""), r"[\s,]+", "")
    milli = F.coalesce(F.rpad(F.regexp_extract(text, clock, 4), 3, "0").try_cast("long"), F.lit(0))
    return F.when(text.rlike(clock), (((part(1) * 60 + part(2)) * 60 + part(3)) * 1000 + milli).cast("double")).when(
        text.rlike(r"(?i)[a-z]") & (F.size(amounts) > 0) & (rest == ""), F.aggregate(each, F.lit(0.0), lambda a, x: a + x)
    )


def _let(x: Column, f) -> Column:
    """``f`` of ``x``, which is computed once however often ``f`` names it (and keeps the generated code small)."""
    return F.get(F.transform(F.array(x), f), F.lit(0))


def _plain_number(n: Column) -> Column:
    return F.when((n == F.floor(n)) & (F.abs(n) < 1e15), n.cast("bigint").cast("string")).otherwise(n.cast("string"))


def canonical(c: Column, target: str, comma: bool = False, order: str = "dmy") -> Column:
    """The text as ``target`` (integer, number, date, datetime, time, duration, boolean) writes it; null where it is none."""
    text = F.trim(c.cast("string"))
    if target in ("integer", "number"):
        return _let(number(c, comma), lambda n: _plain_number(n if target == "number" else F.when(n == F.floor(n), n)))
    if target == "date":
        return F.date_format(F.coalesce(to_date(c, order), text.try_cast("timestamp_ntz").cast("date")), "yyyy-MM-dd")
    if target == "datetime":
        stamp = F.date_format(F.coalesce(text.try_cast("timestamp_ntz"), to_date(c, order).cast("timestamp_ntz")), "yyyy-MM-dd'T'HH:mm:ss.SSS")
        return F.concat(F.regexp_replace(stamp, r"\.000$", ""), F.lit("Z"))
    if target == "time":
        return _let(F.floor(clock_ms(c) / 60_000 + 0.5), lambda m: F.concat(F.lpad((F.floor(m / 60) % 24).cast("string"), 2, "0"), F.lit(":"), F.lpad((m % 60).cast("string"), 2, "0")))
    if target == "duration":
        two = lambda x: F.lpad((x % 60).cast("string"), 2, "0")
        return _let(F.floor(elapsed_ms(c) / 1000 + 0.5), lambda s: F.concat(F.floor(s / 3600).cast("string"), F.lit(":"), two(F.floor(s / 60)), F.lit(":"), two(s)))
    if target == "boolean":
        low = F.lower(text)
        return F.when(low.isin("true", "t", "yes", "y", "1"), "true").when(low.isin("false", "f", "no", "n", "0"), "false")
    raise ValueError(f"no such target: {target}")


def cast(c: Column, target: str, on_fail: str = "coerce") -> Column:
    """Cast without throwing: ``coerce`` gives null where it fails, ``keep`` the text."""
    text = F.trim(c.cast("string"))
    if target == "boolean":
        low = F.lower(text)
        out = F.when(low.isin("true", "yes", "y", "t", "1"), True).when(low.isin("false", "no", "n", "f", "0"), False)
    elif target == "integer":
        n = number(c)
        out = F.when(n == F.floor(n), n.cast("bigint"))
    elif target == "number":
        out = number(c)
    elif target == "date":
        out = to_date(c)
    elif target == "datetime":
        out = text.try_cast("timestamp_ntz")
    else:
        out = text
    return F.coalesce(out.cast("string"), c.cast("string")) if on_fail == "keep" else out


def duration_ms(c: Column) -> Column:
    """``H:MM:SS`` to milliseconds."""
    parts = F.split(F.trim(c), ":")
    ok = F.trim(c).rlike(r"^\d+:[0-5]?\d(:[0-5]?\d(\.\d+)?)?$")
    seconds = F.coalesce(F.get(parts, F.lit(2)).try_cast("double"), F.lit(0.0))
    return F.when(ok, F.get(parts, F.lit(0)).try_cast("bigint") * 3600000 + F.get(parts, F.lit(1)).try_cast("bigint") * 60000 + (seconds * 1000).cast("bigint"))
