"""Pivot tables with margins from raw rows, spread, melt, explode, split."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .aggregate import Measure, measure

TOTAL = "(total)"
MAX_COLUMNS = 500


def pivot_long(df: DataFrame, index: list[str], columns: list[str], measures: list[Measure], margins: bool = True) -> DataFrame:
    """One row for each cell; margin rows have ``(total)`` in the summed-over dimensions.

    Margins are aggregated from the rows, not from cells: one pass with grouping
    sets (cells, row totals, column totals, grand total), told apart by their
    grouping.  A data value ``(total)`` is written ``'(total)'``.
    """
    return _pivot_sets(df, index, columns, measures, margins).drop("_margin")


def _pivot_sets(df: DataFrame, index: list[str], columns: list[str], measures: list[Measure], margins: bool) -> DataFrame:
    """``pivot_long`` with ``_margin``: a bit for each dimension that is summed over, the last the lowest."""
    dims = [*index, *columns]
    keyed = df
    for d in dims:
        label = F.coalesce(F.col(d).cast("string"), F.lit("(missing)"))
        keyed = keyed.withColumn(d, F.when(label == TOTAL, f"'{TOTAL}'").otherwise(label))
    aggs = [measure(m).alias(m.title) for m in measures]
    if not margins:
        return keyed.groupBy(*dims).agg(*aggs).withColumn("_margin", F.lit(0))
    sets = [dims, index, columns, []]
    sets = [s for i, s in enumerate(sets) if s not in sets[:i]]
    out = keyed.groupingSets([[F.col(c) for c in s] for s in sets], *dims).agg(*aggs, F.grouping_id().alias("_margin"))
    return out.select(*[F.coalesce(F.col(d), F.lit(TOTAL)).alias(d) for d in dims], *[F.col(f"`{m.title}`") for m in measures], "_margin")


def pivot_percent(df: DataFrame, index: list[str], columns: list[str], m: Measure, of: str = "row") -> DataFrame:
    """Each cell as a share of its row, column or grand total (from rows)."""
    long = _pivot_sets(df, index, columns, [m], True)
    cell = F.col(f"`{m.title}`").cast("double")
    dims, keys = [*index, *columns], {"row": index, "column": columns, "grand": []}[of]
    bits = sum(1 << (len(dims) - 1 - k) for k, d in enumerate(dims) if d not in keys)
    inside = long.where("_margin = 0").drop("_margin")
    margin = long.where(F.col("_margin") == bits).select(*keys, cell.alias("_margin"))
    joined = inside.join(margin, keys) if keys else inside.crossJoin(F.broadcast(margin))
    return joined.withColumn("share", F.try_divide(cell, F.col("_margin"))).drop("_margin")


def column_values(df: DataFrame, column: str) -> list[str]:
    """The labels that a spread makes columns of; more than the limit is an error, as the result would be unusable."""
    found = [r[0] for r in df.select(F.coalesce(F.col(column).cast("string"), F.lit("(missing)"))).distinct().limit(MAX_COLUMNS + 1).collect()]
    if len(found) > MAX_COLUMNS:
        raise ValueError(f"{column} has more than {MAX_COLUMNS} values")
    return sorted(found)


def pivot_wide(df: DataFrame, index: list[str], column: str, m: Measure, values: list[str] | None = None) -> DataFrame:
    """The matrix form: a column for each value of ``column``."""
    values = values if values is not None else column_values(df, column)
    keyed = df.withColumn(column, F.coalesce(F.col(column).cast("string"), F.lit("(missing)")))
    return keyed.groupBy(*index).pivot(column, values).agg(measure(m))


def spread(df: DataFrame, ids: list[str], key: str, value: str, agg: str = "first", order: str = "_row_id", keys: list[str] | None = None) -> DataFrame:
    """Key values to columns in the order of their first appearance; null keys are ``(empty)``, null values are skipped."""
    named = df.withColumn("_k", F.coalesce(F.trim(F.col(key).cast("string")), F.lit("(empty)")))
    if keys is None:
        firsts = named.groupBy("_k").agg(F.min(order).alias("_at")).orderBy("_at", "_k").limit(MAX_COLUMNS + 1).collect()
        if len(firsts) > MAX_COLUMNS:
            raise ValueError(f"{key} has more than {MAX_COLUMNS} values")
        keys = [r["_k"] for r in firsts]
    v = F.col(value)
    how = F.min_by(v, F.when(v.isNotNull(), F.col(order))) if agg == "first" else measure(Measure(agg, value))
    if agg == "sum":
        how = F.sum(v.cast("double"))
    return named.groupBy(*ids).pivot("_k", keys).agg(how)


def melt(df: DataFrame, ids: list[str], values: list[str] | None = None, variable: str = "variable", value: str = "value", drop_empty: bool = False, strip: str | None = None, order: str | None = None) -> DataFrame:
    """Columns to rows, variable by variable; ``strip`` is a regex taken off the names."""
    values = values or [c for c in df.columns if c not in ids and c != order]
    kept = [*ids, *([order] if order and order not in ids else [])]
    typed = df.select(*kept, *[F.col(c).cast("string").alias(c) for c in values])
    out = typed.unpivot(kept, values, variable, value)
    if drop_empty:
        out = out.where(F.col(value).isNotNull() & (F.trim(value) != ""))
    if strip:
        out = out.withColumn(variable, F.regexp_replace(variable, strip, ""))
    return out


def explode_column(df: DataFrame, column: str, delimiter: str, regex: bool = False, drop_empty: bool = True) -> DataFrame:
    """One row for each trimmed piece; a blank cell, or one of empty pieces only, keeps one row."""
    parts = _pieces(F.col(column), delimiter, regex, drop_empty)
    kept = F.when(F.size(parts) > 0, parts).otherwise(F.array(F.lit("")))
    return df.withColumn(column, F.explode(kept))


def _pieces(c: Column, delimiter: str, regex: bool, drop_empty: bool) -> Column:
    text = F.coalesce(c.cast("string"), F.lit(""))
    parts = F.split(text, delimiter if regex else "\\Q" + delimiter.replace("\\E", "\\E\\\\E\\Q") + "\\E", -1)
    parts = F.transform(parts, lambda x: F.trim(x))
    return F.filter(parts, lambda x: x != "") if drop_empty else parts


def split_column(df: DataFrame, column: str, delimiter: str, regex: bool = False, drop_empty: bool = False, prefix: str | None = None, parts: int | None = None, limit: int = 50) -> DataFrame:
    """Pieces as columns ``prefix_1`` .. after the source; the number of columns is the largest number of pieces."""
    prefix = prefix or column
    pieces = _pieces(F.col(column), delimiter, regex, drop_empty)
    if parts is None:
        parts = df.agg(F.max(F.size(pieces))).first()[0] or 1
    parts = min(parts, limit)
    at = df.columns.index(column) + 1
    taken = {c.lower() for c in df.columns}
    new = []
    for i in range(parts):
        name = f"{prefix}_{i + 1}"
        n = 2
        while name.lower() in taken:
            name = f"{prefix}_{i + 1} ({n})"
            n += 1
        taken.add(name.lower())
        new.append(F.coalesce(F.get(pieces, F.lit(i)), F.lit("")).alias(name))
    cols = [F.col(f"`{c}`") for c in df.columns]
    return df.select(*cols[:at], *new, *cols[at:])


def top_n_other(df: DataFrame, column: str, n: int, name: str = "group") -> DataFrame:
    """``df`` with the ``n`` most frequent labels kept and the rest as ``Other`` (ties by label)."""
    label = F.coalesce(F.col(column).cast("string"), F.lit("(missing)"))
    top = df.groupBy(label.alias("_g")).agg(F.count(F.lit(1)).alias("_n")).orderBy(F.col("_n").desc(), "_g").limit(n).select("_g")
    # At most n rows.
    return df.withColumn("_label", label).join(F.broadcast(top), F.col("_label") == F.col("_g"), "left").withColumn(name, F.coalesce("_g", F.lit("Other"))).drop("_label", "_g")


def first_appearance(df: DataFrame, column: str, order: str) -> DataFrame:
    """Labels by their first row."""
    return df.groupBy(column).agg(F.min(order).alias("first_row")).withColumn("position", F.row_number().over(Window.orderBy("first_row", column)))
