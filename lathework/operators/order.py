"""Functions of the row order in two phases, so that no task sorts the whole table.

The order column's range is cut at literal bounds taken from a bounded sample;
each range is worked on by its own task, and what crosses from one range to the
next (a sum, a count, a last value) is one row for each range.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SAMPLE = 100


#: Rows that one task gets where rows are dealt out by value and counted.
PART_ROWS = 500_000


def parts_of(df: DataFrame, rows: int = 0) -> int:
    """The session's shuffle partitions, or more where ``rows`` would be more than ``PART_ROWS`` for each."""
    return max(2, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-rows // PART_ROWS))


def drawn(df: DataFrame, n: int, seed: int = 0) -> DataFrame:
    """About ``n`` rows of ``df`` at most, each drawn for itself: a filter by hash after a count, so nothing is merged or sorted."""
    share = min(1.0, n / max(1, df.count()))
    draw = F.pmod(F.xxhash64(F.lit(seed), F.monotonically_increasing_id()), F.lit(1 << 40))
    return df.where(draw < int(share * (1 << 40))) if share < 1 else df


def place(df: DataFrame, order: str, then: tuple[str, ...] = ()) -> Column:
    """What rows are put in order by: the order column, ``then``, and a hash of the row for what is equal in these."""
    return F.struct(F.col(f"`{order}`").alias("o"), *[F.col(f"`{c}`").alias(f"t{i}") for i, c in enumerate(then)], F.xxhash64(*[F.col(f"`{c}`") for c in df.columns]).alias("h"))


def range_part(df: DataFrame, order: str, parts: int | None = None, then: tuple[str, ...] = ()) -> Column:
    """The number of the range that holds a row's place; rows without an order value are in the first ones.

    Bounds are literals, so each use of the expression cuts alike.  The sample is
    of rows and the places go on with ``then`` and the row's hash, so an order
    value that many rows have is cut like any other.
    """
    parts = parts or parts_of(df)
    own = df.select(place(df, order, then).alias("p"))
    found = drawn(own, parts * SAMPLE).orderBy("p").toArrow()["p"].combine_chunks() if parts > 1 else []
    at = sorted({i * len(found) // parts for i in range(1, parts)}) if len(found) else []
    bounds = [found[i].as_py() for i in at if i]
    if not bounds:
        return F.lit(0)
    kind = own.schema["p"].dataType
    cuts = F.array(*[F.struct(*[F.lit(b[f.name]).cast(f.dataType).alias(f.name) for f in kind]) for b in bounds])
    return F.size(F.filter(cuts, lambda b: b <= place(df, order, then)))


def attach(df: DataFrame, order: str, specs: list[tuple[str, str, Column | None]], then: tuple[str, ...] = ()) -> DataFrame:
    """``df`` with the named functions of the row order: (name, sum | number | previous, value).

    All of them share one cut: a window by range, and one aggregation whose rows
    (one for each range) carry what crosses.
    """
    cut = df.withColumns({"_part": range_part(df, order, None, then), "_place": place(df, order, then)} | {f"_v{i}": v for i, (_, _, v) in enumerate(specs) if v is not None})
    w = Window.partitionBy("_part").orderBy("_place")
    upto = w.rowsBetween(Window.unboundedPreceding, 0)
    earlier = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    inside, ends, crossing = {"_first": F.row_number().over(w) == 1}, [], [F.col("_part")]
    for i, (_, kind, _) in enumerate(specs):
        if kind == "sum":
            inside[f"_i{i}"] = F.sum(f"_v{i}").over(upto)
            ends.append(F.sum(f"_v{i}").alias(f"_e{i}"))
            crossing.append(F.sum(f"_e{i}").over(earlier).alias(f"_b{i}"))
        elif kind == "number":
            inside[f"_i{i}"] = F.row_number().over(w)
            ends.append(F.count(F.lit(1)).alias(f"_e{i}"))
            crossing.append(F.sum(f"_e{i}").over(earlier).alias(f"_b{i}"))
        else:
            inside[f"_i{i}"] = F.lag(f"_v{i}").over(w)
            ends.append(F.max_by(F.struct(f"_v{i}"), "_place").alias(f"_e{i}"))
            crossing.append(F.lag(f"_e{i}").over(Window.orderBy("_part"))[f"_v{i}"].alias(f"_b{i}"))
    # One row for each range.
    across = cut.groupBy("_part").agg(*ends).select(*crossing)
    joined = cut.withColumns(inside).join(F.broadcast(across), "_part")
    out = {}
    for i, (name, kind, _) in enumerate(specs):
        own, before = F.col(f"_i{i}"), F.col(f"_b{i}")
        if kind == "sum":
            out[name] = F.coalesce(own, F.lit(0.0)) + F.coalesce(before, F.lit(0.0))
        elif kind == "number":
            out[name] = (own + F.coalesce(before, F.lit(0))).cast("long")
        else:
            out[name] = F.when(F.col("_first"), before).otherwise(own)
    return joined.withColumns(out).select(*[F.col(f"`{c}`") for c in df.columns], *out)


def running_sum(df: DataFrame, value: Column, order: str, name: str) -> DataFrame:
    """The sum of ``value`` up to and with each row; nulls add nothing."""
    return attach(df, order, [(name, "sum", value)])


def row_number(df: DataFrame, order: str, name: str, then: tuple[str, ...] = ()) -> DataFrame:
    """1, 2, ... in the order of ``order`` and then ``then`` (nulls first)."""
    return attach(df, order, [(name, "number", None)], then)


def previous(df: DataFrame, value: Column, order: str, name: str) -> DataFrame:
    """The value of the row before, blank or not."""
    return attach(df, order, [(name, "previous", value)])


def carry(df: DataFrame, column: str, order: str, forward: bool = True) -> DataFrame:
    """Nulls of ``column`` filled by the last known value before (or the next after)."""
    cut = df.withColumn("_part", range_part(df, order))
    way = F.col(order).asc() if forward else F.col(order).desc()
    w = Window.partitionBy("_part").orderBy(way).rowsBetween(Window.unboundedPreceding, 0)
    known = F.when(F.col(column).isNotNull(), F.col(order))
    ends = cut.groupBy("_part").agg((F.max_by if forward else F.min_by)(F.col(column), known).alias("_end"))
    across = Window.orderBy(F.col("_part").asc() if forward else F.col("_part").desc()).rowsBetween(Window.unboundedPreceding, -1)
    joined = cut.withColumn("_in", F.last(F.col(column), ignorenulls=True).over(w))
    before = ends.select("_part", F.last("_end", ignorenulls=True).over(across).alias("_before"))
    joined = joined.join(F.broadcast(before), "_part")
    return joined.withColumn(column, F.coalesce("_in", "_before")).select(*df.columns)


def rank_desc(df: DataFrame, value: Column, name: str) -> DataFrame:
    """Competition ranks, largest first; nulls have none.  Ranks come from the counts of distinct values."""
    kept = df.withColumn("_v", value)
    counts = kept.where(F.col("_v").isNotNull()).groupBy((-F.col("_v")).alias("_k")).agg(F.count(F.lit(1)).alias("_n"))
    ranked = running_sum(counts, F.col("_n").cast("double"), "_k", "_upto")
    ranked = ranked.select(F.col("_k"), (F.col("_upto") - F.col("_n") + 1).alias(name))
    return kept.join(ranked, -kept["_v"] == ranked["_k"], "left").drop("_v", "_k")
