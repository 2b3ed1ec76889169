"""The data-quality score: deterministic checks of every column, six weighted dimensions, band caps, failing rows and cells.

``find`` looks at the table in three aggregates (fixed counts of every column,
masks, spellings) and keeps a few facts for each column; whatever judges rows
afterwards is made of them and needs no pass of its own.  What belongs to the
person (pair comparisons, keys, freshness, references) comes in as checks.
"""

from __future__ import annotations

from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import cleans
from ..functions import text as T
from . import profile, review
from .aggregate import finite

#: Weights of the dimensions and the least scores of the bands; fixed values.
WEIGHTS = {"completeness": 30, "validity": 30, "uniqueness": 15, "consistency": 15, "timeliness": 10, "accuracy": 0}
GOOD, FAIR = 90, 75
#: Shares of a column that is empty or invalid from which the band is held down; fixed values.
CAPS = {"fair_empty": 0.5, "poor_empty": 0.75, "fair_invalid": 0.2, "poor_invalid": 0.5}
#: What an optional column's blanks count, and when a column is taken to be one; fixed values.
OPTIONAL_FACTOR, OPTIONAL_EMPTY, OTHERS_EMPTY = 0.25, 0.3, 0.05
#: Words in a column's name that say that it may be blank; fixed values.
OPTIONAL_WORDS = frozenset("note notes comment comments remark remarks memo description middle lot card secondary alt alternate optional additional context clarify specify".split())
#: Share of cells that must read as a type for it to be the intended one, and of numbers that must be whole; fixed values.
INTENDED, WHOLE, LEAST_VALUES = 0.6, 0.95, 5

_DAYS = ("day first", "month first", "ambiguous")


@dataclass(frozen=True)
class Facts:
    """What is known of one column."""

    column: str
    text: bool
    rows: int = 0
    nulls: int = 0
    optional: bool = False
    intended: str | None = None
    layout: str | None = None
    minority_order: str | None = None
    symbols: bool | None = None
    garbled: bool = False
    range: tuple[float, float] | None = None
    mask: str | None = None
    spellings: bool = False
    counts: dict = field(default_factory=dict, hash=False)

    @property
    def empty(self) -> bool:
        return self.rows > 0 and self.nulls >= self.rows


@dataclass(frozen=True)
class Check:
    """A check's result; ``check`` is dimension.kind."""

    dimension: str
    check: str
    column: str | None
    passed: int
    failed: int
    na: int = 0
    optional: bool = False


def _col(c: str) -> Column:
    return F.col(f"`{c}`")


def _marked(df: DataFrame, texts: list[str]) -> DataFrame:
    """``df`` with whether each cell of ``texts`` is missing."""
    df = df.withColumns({f"_plain_{c}": cleans.plain_cell(_col(c)) for c in texts})
    return df.withColumns({f"_gone_{c}": cleans.is_missing(_col(c), plain=_col(f"_plain_{c}")) for c in texts})


def _read(df: DataFrame, facts: list[Facts]) -> DataFrame:
    """``df`` with what the checks of a text column share: its trimmed text (null where it is missing), number and date layout.

    Each is a column of its own, so a cell is read once and not again for every
    check; the steps stay apart, as the optimiser merges none whose results are
    used more than once.
    """
    texts = [f.column for f in facts if f.text]
    df = _marked(df, texts)
    df = df.withColumns({f"_text_{c}": F.when(~_col(f"_gone_{c}"), F.trim(_col(c))) for c in texts})
    return df.withColumns({f"_number_{c}": cleans.number(_col(f"_text_{c}")) for c in texts} | {f"_layout_{c}": review._layout(_col(f"_text_{c}")) for c in texts})


def _text(f: Facts) -> Column:
    """A cell's trimmed text; null where it is missing."""
    return _col(f"_text_{f.column}") if f.text else F.trim(_col(f.column).cast("string"))


def _number(f: Facts) -> Column:
    return _col(f"_number_{f.column}") if f.text else cleans.number(_text(f))


def _kind(f: Facts) -> Column:
    return _col(f"_layout_{f.column}") if f.text else review._layout(_text(f))


def _layout(kind: Column) -> Column:
    """The way a date is written; all orders of day and month are one."""
    return F.when(kind.isin(*_DAYS), F.lit("d/m/y")).when(kind != "other", kind)


def _symbol(s: Column) -> Column:
    return s.rlike(r"[$€£¥]|\d,\d{3}")


def find(df: DataFrame, columns: list[str] | None = None, optional: dict[str, bool] | None = None) -> list[Facts]:
    """The facts of each column."""
    columns = columns or df.columns
    facts = [Facts(c, df.schema[c].dataType.simpleString() == "string") for c in columns]
    aggs = [F.count(F.lit(1)).alias("rows")]
    for i, f in enumerate(facts):
        aggs.append(F.count_if(_col(f"_gone_{f.column}") if f.text else _col(f.column).isNull()).alias(f"nulls_{i}"))
        low_high = next((r for w, r in review.NAMED_RANGES.items() if w in _words(f.column)), None)
        number = _number(f) if f.text else finite(_col(f.column).cast("double")) if profile.is_number(df, f.column) else None
        if low_high and number is not None:
            facts[i] = f = replace(f, range=low_high)
            aggs += [F.count(number).alias(f"judged_{i}"), F.count_if((number < low_high[0]) | (number > low_high[1])).alias(f"outside_{i}")]
        if not f.text:
            continue
        s, kind = _text(f), _kind(f)
        aggs += [
            F.count(number).alias(f"numbers_{i}"),
            F.count_if(s.rlike(r"^[+-]?\d{1,15}$|^[+-]?\d+\.0+$")).alias(f"whole_{i}"),
            F.count_if(s.rlike(r"^0\d+$")).alias(f"zeros_{i}"),
            F.count_if(number.isNotNull() & _symbol(s)).alias(f"symbols_{i}"),
            F.count_if(s.rlike(review.MOJIBAKE)).alias(f"garbled_{i}"),
            *[F.count_if(kind == k).alias(f"{k}_{i}") for k in review.DATE_LAYOUTS],
        ]
    one = _read(df, facts).agg(*aggs).first()
    rows = one["rows"]
    masks, spelt = _masks(df, facts), _minorities(df, facts)
    out = []
    for i, f in enumerate(facts):
        get = lambda k, i=i: one[f"{k}_{i}"]
        f = replace(f, rows=rows, nulls=get("nulls"), counts={"outside": get("outside"), "judged": get("judged")} if f.range else {})
        if f.text:
            cells = rows - f.nulls
            layouts = {k: get(k) for k in review.DATE_LAYOUTS}
            dates = {**{k: n for k, n in layouts.items() if k not in _DAYS}, "d/m/y": sum(layouts[k] for k in _DAYS)}
            all_dates = sum(dates.values())
            numbers, whole = get("numbers"), get("whole")
            intended = None
            if cells >= LEAST_VALUES and numbers >= INTENDED * cells and numbers >= all_dates:
                intended = None if get("zeros") else "integer" if whole >= WHOLE * numbers else "number"
            elif cells >= LEAST_VALUES and all_dates >= INTENDED * cells:
                intended = "date"
            f = replace(f, intended=intended, garbled=get("garbled") > 0)
            f.counts.update(nonconforming=cells - (numbers if intended in ("integer", "number") else all_dates) if intended else 0, garbled=get("garbled"))
            if intended == "date":
                lead = max(dates, key=lambda k: (dates[k], k))
                f.counts.update(dates=all_dates, minority=all_dates - dates[lead])
                f = replace(f, layout=lead if dates[lead] < all_dates else None)
                a, b = layouts["day first"], layouts["month first"]
                if a and b:
                    f = replace(f, minority_order="month first" if a >= b else "day first")
                    f.counts.update(minority_order=min(a, b))
            if intended in ("integer", "number") and 0 < get("symbols") < numbers:
                f = replace(f, symbols=get("symbols") <= numbers - get("symbols"))
                f.counts.update(symbols=min(get("symbols"), numbers - get("symbols")), numbers=numbers)
            if intended is None and f.column in masks:
                f = replace(f, mask=masks[f.column][0])
                f.counts.update(off=masks[f.column][1])
            if intended is None and spelt.get(f.column):
                f = replace(f, spellings=True)
                f.counts.update(spellings=spelt[f.column])
        out.append(f)
    return _optional(out, optional or {})


def _words(column: str) -> set[str]:
    import re

    return set(re.split(r"[^a-z]+", re.sub(r"(?<=[a-z])(?=[A-Z])", " ", column).lower()))


def _optional(facts: list[Facts], marked: dict[str, bool]) -> list[Facts]:
    """Columns that may be blank: by name, or far emptier than all others; ``marked`` decides over both."""
    named = {f.column for f in facts if _words(f.column) & OPTIONAL_WORDS}
    share = {f.column: f.nulls / f.rows if f.rows else 0.0 for f in facts}
    lone = {c for c, e in share.items() if e > OPTIONAL_EMPTY and all(o == c or o in named or share[o] <= OTHERS_EMPTY for o in share)}
    return [replace(f, optional=marked.get(f.column, f.column in named | lone)) for f in facts]


def _stacked(df: DataFrame, facts: list[Facts]) -> DataFrame | None:
    """column, value, n: the different texts of every text column, in one aggregate."""
    texts = [f for f in facts if f.text]
    if not texts:
        return None
    cells = F.array(*[F.struct(F.lit(f.column).alias("column"), F.when(~_col(f"_gone_{f.column}"), _col(f.column)).alias("value")) for f in texts])
    return _marked(df, [f.column for f in texts]).select(F.inline(cells)).where("value is not null").groupBy("column", "value").agg(F.count(F.lit(1)).alias("n"))


def _masks(df: DataFrame, facts: list[Facts]) -> dict[str, tuple[str, int]]:
    """Of each column with a dominant mask: the mask and the cells off it."""
    values = _stacked(df, facts)
    if values is None:
        return {}
    m = values.groupBy("column", profile.mask(F.trim("value")).alias("mask")).agg(F.sum("n").alias("n"))
    top = m.groupBy("column").agg(F.max_by("mask", F.struct("n", "mask")).alias("mask"), F.max("n").alias("n"), F.sum("n").alias("cells")).collect()
    runs = lambda mask: mask.count("A") + mask.count("9")
    return {r["column"]: (r["mask"], r["cells"] - r["n"]) for r in top if r["cells"] >= 50 and r["n"] >= 0.8 * r["cells"] and runs(r["mask"]) >= 2}


def minorities(df: DataFrame, facts: list[Facts]) -> DataFrame | None:
    """column, value, n: spellings of a value that is written another way more often."""
    values = _stacked(df, facts)
    if values is None:
        return None
    key = T.normalize(F.col("value"))
    most = values.groupBy("column", key.alias("key")).agg(F.max_by("value", F.struct("n", "value")).alias("most"), F.count(F.lit(1)).alias("kinds"))
    return values.withColumn("key", key).join(most.where("kinds > 1"), ["column", "key"]).where("value <> most").select("column", "value", "n")


def _minorities(df: DataFrame, facts: list[Facts]) -> dict[str, int]:
    found = minorities(df, facts)
    if found is None:
        return {}
    return {r["column"]: r["n"] for r in found.groupBy("column").agg(F.sum("n").alias("n")).collect()}


def checks(df: DataFrame, facts: list[Facts], more: list[Check] | None = None) -> list[Check]:
    """The results of all checks: of each column, of duplicate rows, and those that come in."""
    out: list[Check] = []
    for f in facts:
        filled = f.rows - f.nulls
        out.append(Check("completeness", "completeness", f.column, filled, f.nulls, 0, f.optional and not f.empty))
        if f.empty:
            continue
        n = f.counts
        bad = min(max(n.get("nonconforming", 0), n.get("off", 0)), filled)
        out.append(Check("validity", "validity", f.column, filled - bad, bad, f.nulls))
        for kind, failed, of in (
            ("dateformat", n.get("minority"), n.get("dates")), ("dateconflict", n.get("minority_order"), filled), ("mojibake", n.get("garbled"), filled),
            ("range", n.get("outside"), n.get("judged")), ("symbols", n.get("symbols"), n.get("numbers")),
        ):
            if failed:
                out.append(Check("validity", f"validity.{kind}", f.column, of - failed, failed, f.nulls))
        if n.get("spellings"):
            out.append(Check("consistency", "consistency.variants", f.column, filled - n["spellings"], n["spellings"], f.nulls))
    copies = profile.dataset_stats(df, [f.column for f in facts]).select("rows", "duplicates").first()
    out.append(Check("uniqueness", "uniqueness.rows", None, (copies["rows"] or 0) - (copies["duplicates"] or 0), copies["duplicates"] or 0))
    return out + list(more or [])


def set_aside(results: list[Check], reviewed: dict[tuple[str, str | None], int]) -> list[Check]:
    """Checks (by name and column) that a person has reviewed count as passed until more rows fail."""
    return [replace(c, passed=c.passed + c.failed, failed=0) if 0 < c.failed <= reviewed.get((c.check, c.column), 0) else c for c in results]


def dimension_scores(results: list[Check]) -> dict[str, float | None]:
    """Each dimension's share of passed checks in percent; None where nothing applies."""
    out: dict[str, float | None] = {}
    for d in WEIGHTS:
        passed = sum(c.passed for c in results if c.dimension == d)
        failed = sum(c.failed * (OPTIONAL_FACTOR if c.optional else 1) for c in results if c.dimension == d)
        out[d] = 100 * passed / (passed + failed) if passed + failed else None
    return out


def band_cap(facts: list[Facts], results: list[Check]) -> tuple[str, str] | None:
    """The band that the worst column allows and why: mostly empty (unless optional) or mostly invalid."""
    worst = None
    found = [("empty", f.column, f.nulls / f.rows) for f in facts if f.rows and not f.optional and not f.empty]
    found += [("invalid", c.column, c.failed / (c.passed + c.failed)) for c in results if c.check == "validity" and c.passed + c.failed]
    for what, column, share in found:
        if share > CAPS[f"fair_{what}"]:
            band = "poor" if share > CAPS[f"poor_{what}"] else "fair"
            if worst is None or band == "poor" and worst[0] == "fair":
                worst = (band, f"{column} is {share:.0%} {what}")
    return worst


def score(df: DataFrame, columns: list[str] | None = None, more: list[Check] | None = None, optional: dict[str, bool] | None = None, weights: dict[str, float] | None = None, reviewed: dict | None = None) -> DataFrame:
    """One row: score, band, reason (of a band that is held down), each dimension."""
    facts = find(df, columns, optional)
    results = set_aside(checks(df, facts, more), reviewed or {})
    parts = dimension_scores(results)
    w = WEIGHTS | (weights or {})
    held = {d: s for d, s in parts.items() if s is not None and w[d] > 0}
    total = sum(w[d] * s for d, s in held.items()) / sum(w[d] for d in held) if held else None
    band = None if total is None else "good" if total >= GOOD else "fair" if total >= FAIR else "poor"
    cap, reason = band_cap(facts, results), None
    if cap and band and ("poor", "fair", "good").index(cap[0]) < ("poor", "fair", "good").index(band):
        band, reason = cap
    row = {"score": total, "band": band, "reason": reason, **parts}
    kinds = ", ".join(f"{k} {'string' if k in ('band', 'reason') else 'double'}" for k in row)
    return df.sparkSession.createDataFrame([tuple(row.values())], kinds)


def check_table(df: DataFrame, columns: list[str] | None = None, more: list[Check] | None = None, optional: dict[str, bool] | None = None) -> DataFrame:
    """One row for each check."""
    rows = [(c.dimension, c.check, c.column, c.passed, c.failed, c.na, c.optional) for c in checks(df, find(df, columns, optional), more)]
    return df.sparkSession.createDataFrame(rows, "dimension string, check string, column string, passed bigint, failed bigint, na bigint, optional boolean")


#: Share of a column's cells that a conversion may blank; fixed value.
MOST_LOST = 0.1


def suggestions(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """What could be done, one row each: kind, column, rows it touches, whether it is held back as it would lose too much.

    Conversions of texts that read as numbers or dates, one date format or order,
    numbers without signs, one spelling a value, placeholders as blanks, wrongly
    decoded text, impossible values, codes for missing numbers, empty columns,
    duplicate rows.
    """
    facts = find(df, columns)
    results = checks(df, facts)
    aggs = [F.count_if(F.coalesce(dict((c, b) for c, _, _, b in _findings(f))["placeholder"], F.lit(False))).alias(f"p{i}") for i, f in enumerate(facts) if f.text and not f.empty]
    held = _read(df, facts).agg(*aggs).first() if aggs else {}
    rows: list[tuple[str, str | None, int, bool]] = []
    for i, f in enumerate(facts):
        n, filled = f.counts, f.rows - f.nulls
        if f.empty:
            rows.append(("drop", f.column, f.rows, False))
            continue
        if f.text and held[f"p{i}"]:
            rows.append(("blank placeholders", f.column, held[f"p{i}"], False))
        if f.intended:
            rows.append((f"convert to {f.intended}", f.column, filled, n["nonconforming"] > MOST_LOST * filled))
        for kind, count in (("one date format", n.get("minority")), ("choose a date order", n.get("minority_order")), ("strip signs", n.get("symbols")), ("merge spellings", n.get("spellings")), ("repair text", n.get("garbled")), ("review values", n.get("outside")), ("review format", n.get("off"))):
            if count:
                rows.append((kind, f.column, count, False))
        if not f.text and profile.is_number(df, f.column):
            rows += [(f"missing code {r['value']:g}", f.column, r["n"], False) for r in review.sentinels(df, f.column).collect()]
    copies = next(c for c in results if c.check == "uniqueness.rows")
    if copies.failed:
        rows.append(("remove duplicates", None, copies.failed, False))
    return df.sparkSession.createDataFrame(rows, "kind string, column string, rows bigint, blocked boolean")


# -- rows and cells -----------------------------------------------------------


def _findings(f: Facts, placeholders: bool = True) -> list[tuple[str, str, str, Column]]:
    """(check, severity, reason, whether a cell fails) of one column, in the order in which a cell is judged.

    The conditions are on what ``_read`` adds.
    """
    raw, s = _col(f.column), _text(f)
    blank = raw.isNull() | (F.trim(raw.cast("string")) == "")
    out = []
    if f.text and placeholders:
        out.append(("placeholder", "fix", "Placeholder stored as text", _col(f"_gone_{f.column}") & ~blank))
    if not f.optional:
        out.append(("completeness", "info", "Empty cell", blank))
    if f.intended in ("integer", "number"):
        out.append(("validity", "fix", f"Does not read as {f.intended}", s.isNotNull() & _number(f).isNull()))
    elif f.intended == "date":
        out.append(("validity", "fix", "Does not read as date", s.isNotNull() & _layout(_kind(f)).isNull()))
    if f.range:
        x = _number(f) if f.text else finite(raw.cast("double"))
        out.append(("validity.range", "fix", f"Outside {f.range[0]} to {f.range[1]}", (x < f.range[0]) | (x > f.range[1])))
    if f.spellings:
        out.append(("consistency.variants", "fix", "Spelling variant of another value", F.col(f"_minor_{f.column}")))
    if f.layout:
        out.append(("validity.dateformat", "review", "Date written in another format than most of the column", _layout(_kind(f)) != f.layout))
    if f.garbled:
        out.append(("validity.mojibake", "fix", "Text looks wrongly decoded", s.rlike(review.MOJIBAKE)))
    if f.minority_order:
        out.append(("validity.dateconflict", "review", "Date order disagrees with most of the column", _kind(f) == f.minority_order))
    if f.symbols is not None:
        out.append(("validity.symbols", "review", "Number written in another style than most of the column", _number(f).isNotNull() & (_symbol(s) == f.symbols)))
    if f.mask is not None:
        out.append(("validity.pattern", "review", f"Does not match {f.mask}", s.isNotNull() & (profile.mask(s) != f.mask)))
    return [(c, v, r, F.coalesce(hit, F.lit(False))) for c, v, r, hit in out]


def _with_minorities(df: DataFrame, facts: list[Facts]) -> DataFrame:
    """``df`` with a flag for each column whose minority spellings count."""
    rare = None
    for f in facts:
        if f.spellings:
            rare = minorities(df, [x for x in facts if x.spellings]) if rare is None else rare
            own = rare.where(F.col("column") == f.column).select(F.col("value").alias(f"_of_{f.column}"), F.lit(True).alias(f"_minor_{f.column}"))
            df = df.join(own, _col(f.column) == F.col(f"`_of_{f.column}`"), "left").drop(f"_of_{f.column}")
    return df


def rows_affected(df: DataFrame, facts: list[Facts]) -> DataFrame:
    """One row: how many rows fail a deterministic check in any cell (empty cells do not count), and all rows."""
    hit = F.lit(False)
    for f in facts:
        for check, _, _, bad in _findings(f):
            if check not in ("completeness", "validity.range"):
                hit = hit | bad
    return _with_minorities(_read(df, facts), facts).agg(F.count_if(hit).alias("affected"), F.count(F.lit(1)).alias("rows"))


def exceptions(df: DataFrame, facts: list[Facts], order: str, masked: tuple[str, ...] = ()) -> DataFrame:
    """One row for each failing cell, by the first check that it fails: row, column, check, dimension, severity, value, reason.

    Values of ``masked`` columns are shown as masks.
    """
    cells = []
    for f in facts:
        value = F.coalesce(_col(f.column).cast("string"), F.lit(""))
        value = profile.mask(value) if f.column in masked else value
        one = F.lit(None)
        kind = "struct<column:string,check:string,dimension:string,severity:string,value:string,reason:string>"
        for check, severity, reason, bad in reversed(_findings(f)):
            dimension = "completeness" if check == "placeholder" else check.split(".")[0]
            row = F.struct(F.lit(f.column).alias("column"), F.lit(check).alias("check"), F.lit(dimension).alias("dimension"), F.lit(severity).alias("severity"), value.alias("value"), F.lit(reason).alias("reason"))
            one = F.when(bad, row).otherwise(one)
        cells.append(one.cast(kind))
    found = _with_minorities(_read(df, facts), facts).select(_col(order).alias("row"), F.explode(F.filter(F.array(*cells), lambda c: c.isNotNull())).alias("c"))
    return found.select("row", "c.*")


# -- checks that a person asks for --------------------------------------------


def pair(df: DataFrame, a: str, b: str, op: str = "gte", tolerance: float = 0.0) -> Check:
    """A comparison of two columns, for consistency."""
    r = profile.pair_check(df, a, b, op, tolerance).first()
    return Check("consistency", "consistency.pair", a, r["passed"], r["failed"], r["not_judged"])


def key(df: DataFrame, keys: list[str]) -> Check:
    """A key's repeated rows, for uniqueness."""
    r = profile.key_duplicates(df, keys).select("beyond_first").first()
    n = df.count()
    return Check("uniqueness", "uniqueness.key", keys[0], n - r[0], r[0])


def fresh(df: DataFrame, column: str, since: str) -> Check:
    """Dates not before ``since``, for timeliness."""
    late = _col(column).cast("timestamp_ntz") < F.lit(since).cast("timestamp_ntz")
    r = df.agg(F.count_if(~late).alias("a"), F.count_if(late).alias("b"), F.count_if(late.isNull()).alias("c")).first()
    return Check("timeliness", "timeliness.fresh", column, r["a"], r["b"], r["c"])


def reference(df: DataFrame, column: str, kind: str | None = None) -> Check:
    """Values that a reference list knows, for accuracy."""
    n = df.where(_col(column).isNotNull()).count()
    bad = review.reference_accuracy(df, column, kind).agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    return Check("accuracy", "accuracy.reference", column, n - bad, bad, 0)
