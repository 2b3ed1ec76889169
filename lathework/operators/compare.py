"""Comparing two versions of a table: match rows, find changes, measure shifts."""

from __future__ import annotations

import re

from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from .aggregate import finite
from .durable import durable
from .order import parts_of
from .quantiles import HOT_SHARE, quantiles, with_quantiles


def key_token(c: Column, kind: str, lower: bool = False) -> Column:
    """A key cell's canonical form: numbers and dates by value, texts trimmed and space-collapsed; empty is null."""
    if kind in ("number", "date"):
        return c.cast("double").cast("string") if kind == "number" else c.cast("timestamp_ntz").cast("string")
    out = F.trim(F.regexp_replace(c.cast("string"), r"\s+", " "))
    out = F.lower(out) if lower else out
    return F.when(out != "", out)


def kind_of(df: DataFrame, column: str) -> str:
    t = df.schema[column].dataType.simpleString()
    return "number" if t in ("tinyint", "smallint", "int", "bigint", "float", "double") or t.startswith("decimal") else "date" if t.startswith(("date", "timestamp")) else "text"


def cells_equal(a: Column, b: Column, kind: str, absolute: float = 0.0, relative: float = 0.0) -> Column:
    """Equal, both blank, or numbers within either tolerance of the larger magnitude."""
    if kind == "number":
        x, y = a.cast("double"), b.cast("double")
        close = (F.abs(x - y) <= F.lit(absolute)) | (F.abs(x - y) <= relative * F.greatest(F.abs(x), F.abs(y)))
        return F.coalesce(close, F.lit(False)) | a.eqNullSafe(b)
    return a.eqNullSafe(b)


def _side(df: DataFrame, keys: list[str], order: str, columns: list[str], name: str) -> DataFrame:
    tokens = [key_token(F.col(k), kind_of(df, k)).alias(f"_k{i}") for i, k in enumerate(keys)]
    cols = [F.col(f"`{c}`").alias(f"{name}_{c}") for c in columns]
    side = df.select(*tokens, F.col(order).alias(f"_{name}_at"), *cols)
    whole = reduce(lambda x, y: x & y, [F.col(f"_k{i}").isNotNull() for i in range(len(keys))])
    w = Window.partitionBy(*[f"_k{i}" for i in range(len(keys))]).orderBy(f"_{name}_at")
    # The n-th row of a key meets the n-th of the other side; an incomplete key meets nothing.
    return side.withColumn("_nth", F.when(whole, F.row_number().over(w)))


def match(a: DataFrame, b: DataFrame, keys: list[str], order: str, columns: list[str] | None = None, absolute: float = 0.0, relative: float = 0.0) -> DataFrame:
    """Full outer match: status (identical, changed, only A, only B), both sides' cells and a flag for each changed column."""
    columns = columns or [c for c in a.columns if c in b.columns and c != order]
    left, right = _side(a, keys, order, columns, "a"), _side(b, keys, order, columns, "b")
    ks = [f"_k{i}" for i in range(len(keys))]
    cond = [left[k] == right[k] for k in ks] + [left["_nth"] == right["_nth"]]
    both = left.join(right, cond, "full").drop(*[right[k] for k in [*ks, "_nth"]], *[left[k] for k in [*ks, "_nth"]])
    rest = [c for c in columns if c not in keys]
    matched = F.col("_a_at").isNotNull() & F.col("_b_at").isNotNull()
    for c in rest:
        same = cells_equal(F.col(f"`a_{c}`"), F.col(f"`b_{c}`"), kind_of(a, c), absolute, relative)
        both = both.withColumn(f"changed_{c}", matched & ~same)
    changed = reduce(lambda x, y: x | y, [F.col(f"`changed_{c}`") for c in rest], F.lit(False))
    status = F.when(F.col("_b_at").isNull(), "only A").when(F.col("_a_at").isNull(), "only B").when(changed, "changed").otherwise("identical")
    return both.withColumn("status", status)


def summary(matched: DataFrame) -> DataFrame:
    return matched.groupBy("status").agg(F.count(F.lit(1)).alias("n"))


def changed_counts(matched: DataFrame) -> DataFrame:
    """How many matched rows differ, by column."""
    cols = [c for c in matched.columns if c.startswith("changed_")]
    one = matched.agg(*[F.count_if(F.col(f"`{c}`")).alias(c[8:]) for c in cols])
    return one.unpivot([], [c[8:] for c in cols], "column", "n")


def changes_long(matched: DataFrame, keys: list[str]) -> DataFrame:
    """One row for each changed cell: keys, column, old, new."""
    cols = [c[8:] for c in matched.columns if c.startswith("changed_")]
    cells = F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"`a_{c}`").cast("string").alias("old"), F.col(f"`b_{c}`").cast("string").alias("new"), F.col(f"`changed_{c}`").alias("hit")) for c in cols])
    ks = [F.coalesce(F.col(f"`a_{k}`"), F.col(f"`b_{k}`")).alias(k) for k in keys]
    out = matched.where("status = 'changed'").select(*ks, F.explode(F.filter(cells, lambda x: x["hit"])).alias("_c"))
    return out.select(*keys, F.col("_c.column").alias("column"), F.col("_c.old").alias("old"), F.col("_c.new").alias("new"))


def content_match(a: DataFrame, b: DataFrame, columns: list[str]) -> DataFrame:
    """Whole rows as bags: copies pair one to one; counts of rows in both, only in A, only in B."""
    one = lambda df, n: df.groupBy(*[F.col(f"`{c}`").cast("string").alias(c) for c in columns]).agg(F.count(F.lit(1)).alias(n))
    left, right = one(a, "na"), one(b, "nb").withColumnsRenamed({c: f"_{c}" for c in columns})
    both = left.join(right, [left[c].eqNullSafe(right[f"_{c}"]) for c in columns], "full")
    na, nb = F.coalesce("na", F.lit(0)), F.coalesce("nb", F.lit(0))
    return both.agg(F.sum(F.least(na, nb)).alias("both"), F.sum(F.greatest(na - nb, F.lit(0))).alias("only_a"), F.sum(F.greatest(nb - na, F.lit(0))).alias("only_b"))


def position_match(a: DataFrame, b: DataFrame, order: str, columns: list[str]) -> DataFrame:
    """Row n with row n (by the order column)."""
    left = a.select(F.col(order).alias("_n"), *[F.col(c).alias(f"a_{c}") for c in columns])
    right = b.select(F.col(order).alias("_n"), *[F.col(c).alias(f"b_{c}") for c in columns])
    return left.join(right, "_n", "full")


def value_diffs(matched: DataFrame, column: str, kind: str = "sub") -> DataFrame:
    """Row differences of a number: sub (b-a), rsub, pct, ratio, abs; a zero base gives null unless both are zero."""
    x, y = finite(F.col(f"`a_{column}`")), finite(F.col(f"`b_{column}`"))
    zero = (x == 0) & (y == 0)
    d = {
        "sub": y - x,
        "rsub": x - y,
        "abs": F.abs(y - x),
        "pct": F.when(zero, 0.0).otherwise(F.try_divide(y - x, F.abs(x))),
        "ratio": F.when(zero, 1.0).otherwise(F.try_divide(y, x)),
    }[kind]
    return matched.withColumn("diff", d)


def pair_columns(a: list[str], b: list[str]) -> dict[str, str]:
    """Column names of A to those of B: exact first, then letters and digits only."""
    fold = lambda s: "".join(ch for ch in s.lower() if ch.isalnum())
    out = {c: c for c in a if c in b}
    left = {fold(c): c for c in reversed(b) if c not in out.values()}
    for c in a:
        if c not in out and fold(c) in left:
            out[c] = left.pop(fold(c))
    return out


#: A key's most flawed rows, its least shared values, and the columns of which pairs are tried; fixed values.
MOST_FLAWED, LEAST_SHARED, POOL = 0.01, 0.1, 6
#: What ranks keys of like overlap: an id-like name, a type that keys have, flaws; fixed values.
NAMED, KEY_TYPE, FLAWED = 0.1, 0.02, 0.005


def id_like(name: str) -> bool:
    """Whether a column's name says that it names rows."""
    return bool(re.search(r"(^|[^a-z])(id|key|code|no|number|ref|uuid|guid)$|key$|Id$|ID$", name if re.search(r"I[dD]$", name) else name.lower()))


def suggest_keys(a: DataFrame, b: DataFrame, columns: list[str]) -> DataFrame:
    """For each column: rows, empty, distinct on A, the share of A's values that B has too, and a score.

    Usable keys are filled and unique on both sides but for ``MOST_FLAWED`` of the
    rows and share ``LEAST_SHARED`` of B's values.  An id-like name and a whole
    number or text edge out near ties.
    """
    return _keys(a, b, [[c] for c in columns])


def suggest_key_pairs(a: DataFrame, b: DataFrame, columns: list[str]) -> DataFrame:
    """The best keys: usable single columns, or else pairs of the most varied columns without blanks."""
    singles = _keys(a, b, [[c] for c in columns])
    found = singles.collect()  # a row for each column
    if any(r["usable"] for r in found):
        return singles.where("usable").orderBy(F.col("score").desc(), "column")
    pool = sorted((r for r in found if r["filled"] == r["rows"] and r["kinds"] > 1), key=lambda r: (-r["kinds"], columns.index(r["column"])))[:POOL]
    names = sorted((r["column"] for r in pool), key=columns.index)
    pairs = [[x, y] for i, x in enumerate(names) for y in names[i + 1 :]]
    if not pairs:
        return singles.where("usable")
    return _keys(a, b, pairs).where("usable").orderBy(F.col("score").desc(), "column")


def _keys(a: DataFrame, b: DataFrame, keys: list[list[str]]) -> DataFrame:
    """All keys in one aggregate of both sides: each row gives one token for each key.

    Tokens go by value to tasks of about ``PART_ROWS`` tokens, whatever the
    session's partitions, so no task's counts grow with the table.  Blanks, and
    values that a sketch finds in more than one of ``HOT_SHARE`` rows, are counted
    for each task that they come from and then added up.
    """
    tokens = []
    for k in keys:
        parts = [F.trim(F.col(f"`{c}`").cast("string")) for c in k]
        full = reduce(lambda x, y: x & y, [p.isNotNull() & (p != "") for p in parts])
        tokens.append(F.when(full, F.concat_ws("\x1f", *parts)))
    # Four times the items asked for keep the sketch's error under half of the share: no hot value is missed.
    sketch = [F.call_function("approx_top_k", x, F.lit(HOT_SHARE), F.lit(4 * HOT_SHARE)).alias(f"t{i}") for i, x in enumerate(tokens)]
    sides = reduce(DataFrame.unionAll, [df.agg(F.count(F.lit(1)).alias("rows"), *sketch) for df in (a, b)]).collect()  # two rows
    hot = [sorted({x["item"] for s in sides for x in s[f"t{i}"] or [] if x["item"] is not None and x["count"] * HOT_SHARE > s["rows"]}) for i in range(len(keys))]

    def side(df: DataFrame, mine: bool) -> DataFrame:
        cells = [F.struct(F.lit(i).alias("key"), F.col(f"t{i}").alias("v"), F.when(F.col(f"t{i}").isNull() | F.col(f"t{i}").isin(h), F.col("at")).alias("at")) for i, h in enumerate(hot)]
        df = df.select(F.spark_partition_id().alias("at"), *[x.alias(f"t{i}") for i, x in enumerate(tokens)])
        return df.select(F.inline(F.array(*cells))).withColumn("mine", F.lit(mine))

    each = side(a, True).unionAll(side(b, False)).repartition(parts_of(a, len(keys) * sum(s["rows"] for s in sides)), "key", "v", "at")
    met = each.groupBy("key", "v", "at").agg(F.count_if("mine").alias("na"), F.count_if(~F.col("mine")).alias("nb"))
    in_a, in_b = F.col("na") > 0, F.col("nb") > 0
    facts = {
        "kinds": in_a.cast("long"), "filled": F.when(in_a, F.col("na")), "shared": (in_a & in_b).cast("long"),
        "kinds_b": in_b.cast("long"), "filled_b": F.when(in_b, F.col("nb")), "hits": F.when(in_a, F.col("nb")),
    }
    # What lies in one task is one row for each key; a hot value's counts are added up before they tell anything.
    shares = met.groupBy("key", F.col("at").isNotNull().alias("hot"), F.when(F.col("at").isNotNull(), F.col("v")).alias("v"))
    shares = shares.agg(F.sum("na").alias("na"), F.sum("nb").alias("nb"), *[F.sum(x).alias(f"_{n}") for n, x in facts.items()])
    found = [F.sum(F.when(~F.col("hot"), F.col(f"_{n}")).when(F.col("v").isNotNull(), x)).alias(n) for n, x in facts.items()]
    out = shares.groupBy("key").agg(F.sum("na").alias("rows"), F.sum("nb").alias("rows_b"), *found)
    out = out.where("rows > 0 and rows_b > 0 and kinds is not null").withColumn("hits", F.coalesce("hits", F.lit(0)))
    kinds = [a.schema[k[0]].dataType.simpleString() for k in keys]
    named = F.array(*[F.lit(NAMED if len(k) == 1 and id_like(k[0]) else 0.0) for k in keys])
    typed = F.array(*[F.lit(KEY_TYPE if t in ("string", "int", "bigint", "smallint", "tinyint") else 0.0) for t in kinds])
    names = F.array(*[F.lit(" + ".join(k)) for k in keys])
    flawed = (F.col("rows") - F.col("kinds")) / F.col("rows")
    flawed_b = (F.col("rows_b") - F.col("kinds_b")) / F.col("rows_b")
    overlap = F.coalesce(F.try_divide(F.col("hits"), F.col("filled_b")), F.lit(0.0))
    out = out.withColumn("flawed", flawed).withColumn("flawed_b", flawed_b).withColumn("overlap", overlap)
    any_flaw = F.when((F.col("flawed") > 0) | (F.col("flawed_b") > 0), FLAWED).otherwise(0.0)
    score = F.col("overlap") + F.get(named, F.col("key")) + F.get(typed, F.col("key")) - any_flaw
    usable = (F.col("flawed") <= MOST_FLAWED) & (F.col("flawed_b") <= MOST_FLAWED) & (F.col("overlap") >= LEAST_SHARED)
    return out.select(F.get(names, F.col("key")).alias("column"), "rows", "kinds", "filled", "shared", "flawed", "flawed_b", "overlap", score.alias("score"), usable.alias("usable"))


# -- shifts ------------------------------------------------------------------

EPSILON = 1e-4


def psi(a: DataFrame, b: DataFrame, column: str) -> DataFrame:
    """Population stability index over A's deciles, and the standardised mean difference.

    One aggregate a side: how many values reach each edge, mean and variance.
    """
    x = finite(F.col(column))
    edges = quantiles(a, x, [i / 10 for i in range(1, 10)], name="_edges")

    def side(df: DataFrame, s: str) -> DataFrame:
        reach = [F.count_if(x >= F.col("_edges")[i]).alias(f"r{i}") for i in range(9)]
        one = df.join(F.broadcast(edges)).agg(F.count(x).alias("n"), F.avg(x).alias(f"m{s}"), F.var_samp(x).alias(f"v{s}"), *reach)
        upto = [F.col("n"), *[F.col(f"r{i}") for i in range(9)], F.lit(0)]
        shares = [F.greatest(F.coalesce(F.try_divide(upto[i] - upto[i + 1], F.col("n")), F.lit(0.0)), F.lit(EPSILON)) for i in range(10)]
        return one.select(f"m{s}", f"v{s}", F.array(*shares).alias(f"s{s}"))

    both = side(a, "a").crossJoin(side(b, "b"))
    terms = F.zip_with("sa", "sb", lambda p, q: (q - p) * F.log(q / p))
    both = both.withColumn("psi", F.aggregate(terms, F.lit(0.0), lambda t, v: t + v))
    smd = F.try_divide(F.col("mb") - F.col("ma"), F.sqrt((F.col("va") + F.col("vb")) / 2))
    band = F.when(F.col("psi") < 0.1, "none").when(F.col("psi") < 0.25, "mild").otherwise("large")
    return both.select(F.lit(column).alias("column"), "psi", smd.alias("smd"), band.alias("shift"))


def category_shift(a: DataFrame, b: DataFrame, column: str) -> DataFrame:
    """Cramér's V of side against label, with labels that appeared and vanished."""
    label = F.coalesce(F.trim(F.col(column).cast("string")), F.lit("(empty)"))
    one = lambda df, n: df.groupBy(label.alias("label")).agg(F.count(F.lit(1)).alias(n))
    both = one(a, "na").join(one(b, "nb"), "label", "full").na.fill(0, ["na", "nb"])
    t = both.agg(F.sum("na").alias("ta"), F.sum("nb").alias("tb"))
    ea = (F.col("na") + F.col("nb")) * F.col("ta") / (F.col("ta") + F.col("tb"))
    eb = (F.col("na") + F.col("nb")) * F.col("tb") / (F.col("ta") + F.col("tb"))
    chi = (F.col("na") - ea) ** 2 / ea + (F.col("nb") - eb) ** 2 / eb
    return both.join(F.broadcast(t)).agg(
        F.lit(column).alias("column"),
        F.sqrt(F.sum(chi) / F.first(F.col("ta") + F.col("tb"))).alias("v"),
        F.count_if((F.col("na") == 0) & (F.col("nb") > 0)).alias("appeared"),
        F.count_if((F.col("nb") == 0) & (F.col("na") > 0)).alias("vanished"),
    )


def group_shift(a: DataFrame, b: DataFrame, group: str, column: str, top: int = 40) -> DataFrame:
    """Mean, sum and count by group on each side; the groups with the most rows."""
    one = lambda df, s: df.groupBy(F.col(group).alias("group")).agg(F.avg(finite(F.col(column))).alias(f"mean_{s}"), F.sum(finite(F.col(column))).alias(f"sum_{s}"), F.count(F.lit(1)).alias(f"n_{s}"))
    both = one(a, "a").join(one(b, "b"), "group", "full")
    rows = F.coalesce("n_a", F.lit(0)) + F.coalesce("n_b", F.lit(0))
    return both.withColumn("rows", rows).orderBy(F.col("rows").desc(), "group").limit(top)


# -- fuzzy keys --------------------------------------------------------------

#: Abbreviations spelt out and words that say little; fixed values.
ABBREVIATIONS = {
    "st": "street", "rd": "road", "ave": "avenue", "av": "avenue", "dr": "drive", "ln": "lane", "ct": "court", "pl": "place", "blvd": "boulevard", "hwy": "highway",
    "mt": "mount", "ste": "suite", "apt": "apartment", "intl": "international", "assoc": "associates", "bros": "brothers",
}
NOISE = frozenset("the pty ltd limited inc incorporated llc co corp corporation company plc gmbh and".split())


def fuzzy_key(text: str | None) -> str:
    words = T.normalize_full("".join(c if c.isalnum() else " " for c in (text or ""))).split()
    words = [ABBREVIATIONS.get(w, w) for w in words]
    return " ".join([w for w in words if w not in NOISE] or words)


def fuzzy_match(a: DataFrame, b: DataFrame, key: str, a_id: str, b_id: str, least: float = 0.8, checks: list[str] | None = None, block_limit: int | None = None, candidates: int | None = None) -> DataFrame:
    """Pairs of leftover rows whose text keys are alike: candidates share a word or a 4-letter beginning, and all numbers.

    Every such pair is scored, by different keys: equal keys of a side are one.
    Two limits can be set instead, as the rule this follows has them (150 and
    40): blocks that more than ``block_limit`` keys share are left out, and only
    a key's best ``candidates`` by shared blocks are scored.  Pairs are taken from the highest rank down, each row once.  Columns
    in ``checks`` that agree raise a pair's rank.  Texts whose numbers differ
    never match.
    """
    key_udf = F.pandas_udf(lambda s: s.map(fuzzy_key), "string")

    def score(x: pd.Series, y: pd.Series) -> pd.Series:
        out = []
        for p, q in zip(x, y, strict=True):
            if re.findall(r"\d+", p) != re.findall(r"\d+", q):
                out.append(0.0)
            else:
                out.append(max(T.jaro_winkler(p, q), T.jaro_winkler(" ".join(sorted(p.split())), " ".join(sorted(q.split())))))
        return pd.Series(out)

    score_udf = F.pandas_udf(score, "double")

    def side(df: DataFrame, ident: str, n: str) -> DataFrame:
        return df.select(F.col(ident).alias(f"{n}_id"), key_udf(F.col(key).cast("string")).alias(f"{n}_key")).where(f"{n}_key != ''")

    def blocked(keyed: DataFrame, n: str) -> DataFrame:
        words = F.split(f"{n}_key", " ")
        starts = F.transform(F.filter(words, lambda w: F.char_length(w) >= 4), lambda w: F.concat(F.lit("^"), F.substring(w, 1, 4)))
        # Texts whose numbers differ never match, so the numbers are a part of the block.
        digits = F.array_join(F.regexp_extract_all(f"{n}_key", F.lit(r"(\d+)"), F.lit(1)), ",")
        return keyed.select(f"{n}_key").distinct().select(f"{n}_key", digits.alias("digits"), F.explode(F.array_distinct(F.concat(words, starts))).alias("block"))

    left, right = side(a, a_id, "a"), side(b, b_id, "b")
    mine, theirs = blocked(left, "a"), blocked(right, "b")
    if block_limit is not None:
        small = theirs.groupBy("block").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") <= block_limit).select("block")
        theirs = theirs.join(small, "block", "left_semi")
    votes = mine.join(theirs, ["block", "digits"]).groupBy("a_key", "b_key").agg(F.count(F.lit(1)).alias("votes"))
    if candidates is not None:
        top = Window.partitionBy("a_key").orderBy(F.col("votes").desc(), "b_key")
        votes = votes.withColumn("_n", F.row_number().over(top)).where(F.col("_n") <= candidates)
    scored = votes.withColumn("score", score_udf("a_key", "b_key")).where(F.col("score") >= least).select("a_key", "b_key", "score")
    scored = scored.join(left, "a_key").join(right, "b_key")
    scored = scored.select("a_id", "b_id", "score")
    rank, support = F.col("score"), F.lit(False)
    if checks:
        # Columns that agree lift a pairing, those that differ lower it a little.
        pick = lambda df, ident, n: df.select(F.col(ident).alias(f"{n}_id"), *[F.col(f"`{c}`").cast("string").alias(f"_{n}{i}") for i, c in enumerate(checks)])
        scored = scored.join(pick(a, a_id, "a"), "a_id").join(pick(b, b_id, "b"), "b_id")
        known = [F.col(f"_a{i}").isNotNull() & F.col(f"_b{i}").isNotNull() for i in range(len(checks))]
        checked = sum((k.cast("int") for k in known), F.lit(0))
        agree = sum(((k & (F.col(f"_a{i}") == F.col(f"_b{i}"))).cast("int") for i, k in enumerate(known)), F.lit(0))
        share = F.try_divide(agree, checked)
        rank = F.col("score") + F.coalesce(0.08 * share - 0.02 * (1 - share), F.lit(0.0))
        support = F.coalesce(share >= 0.5, F.lit(False))
    best = Window.partitionBy("a_id").orderBy(F.col("score").desc(), "b_id")
    gap = F.coalesce(F.col("_best") - F.col("_next") < GAP, F.lit(False))
    scored = scored.withColumn("rank", rank).withColumn("support", support).withColumn("_best", F.max("score").over(Window.partitionBy("a_id"))).withColumn("_second", F.lead("score").over(best)).withColumn("_first", F.row_number().over(best))
    scored = scored.withColumn("_next", F.max(F.when(F.col("_first") == 1, F.col("_second"))).over(Window.partitionBy("a_id"))).withColumn("ambiguous", gap)
    confident = ~F.col("ambiguous") & ((F.col("score") >= CONFIDENT) | F.col("support") & (F.col("score") >= SUPPORTED))
    edges = scored.select("a_id", "b_id", "score", "rank", "ambiguous", confident.alias("confident"))
    return one_to_one(edges).select("a_id", "b_id", "score", "ambiguous", "confident")


#: How near a second candidate makes a pairing ambiguous; scores that make one confident, alone or with agreeing columns; fixed values.
GAP, CONFIDENT, SUPPORTED = 0.02, 0.96, 0.88


#: Rounds of mutual best pairs before what is left is resolved by component; edges of a component that one task takes.
ROUNDS, COMPONENT = 3, 200_000


def one_to_one(edges: DataFrame, rounds: int = ROUNDS, component: int = COMPONENT) -> DataFrame:
    """Of candidate pairs (a_id, b_id, rank) those that the greedy rule takes: the highest rank first, each id once.

    A pair that is the best one left of both its ids is what the greedy rule
    takes too, so ``rounds`` rounds take such pairs.  A long falling chain of
    ranks would need as many rounds as it has pairs: what is left then falls into
    connected components, and one ordered pass resolves each component of at
    most ``component`` pairs.  Larger ones go on in rounds.  Each step is cut off
    durably.
    """
    taken, left, names = None, durable(edges), edges.columns
    while not left.isEmpty():
        for _ in range(rounds):
            left, best = _mutual(left)
            taken = best if taken is None else taken.unionByName(best)
        if left.isEmpty():
            break
        home = _components(left)
        sizes = home.groupBy("_root").agg(F.count(F.lit(1)).alias("_n"))
        placed = durable(home.join(sizes, "_root"))
        kind = edges.schema

        def resolve(pdf: pd.DataFrame) -> pd.DataFrame:
            pdf = pdf.sort_values(["rank", "a_id", "b_id"], ascending=[False, True, True])
            a_seen, b_seen, keep = set(), set(), []
            for x, y in zip(pdf["a_id"], pdf["b_id"], strict=True):
                ok = x not in a_seen and y not in b_seen
                if ok:
                    a_seen.add(x)
                    b_seen.add(y)
                keep.append(ok)
            return pdf[keep][names]

        small = durable(placed.where(F.col("_n") <= component).groupBy("_root").applyInPandas(resolve, kind))
        taken = taken.unionByName(small)
        left = durable(placed.where(F.col("_n") > component).select(*edges.columns))
    return edges.limit(0) if taken is None else taken


def _mutual(left: DataFrame) -> tuple[DataFrame, DataFrame]:
    """What is left after taking the pairs that are best for both ids, and these."""
    order = [F.col("rank").desc(), "a_id", "b_id"]
    ranked = left.withColumn("_a", F.row_number().over(Window.partitionBy("a_id").orderBy(*order))).withColumn("_b", F.row_number().over(Window.partitionBy("b_id").orderBy(*order)))
    best = durable(ranked.where("_a = 1 and _b = 1").drop("_a", "_b"))
    return durable(left.join(best.select("a_id"), "a_id", "left_anti").join(best.select("b_id"), "b_id", "left_anti")), best


def _components(edges: DataFrame) -> DataFrame:
    """``edges`` with ``_root``, one value for each connected component, by alternating stars.

    Nodes are numbers: a hash of the side and the id.  In each step every node
    ties its larger neighbours, then itself and its smaller ones, to the smallest
    that it knows, until nothing changes: a few steps for any shape.
    """
    node = lambda side, c: F.xxhash64(F.lit(side), F.col(c))
    named = edges.withColumns({"_u": node("a", "a_id"), "_v": node("b", "b_id")})
    held = durable(named.select(F.greatest("_u", "_v").alias("u"), F.least("_u", "_v").alias("v")).distinct())
    while True:
        both = held.unionByName(held.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v").distinct()
        down = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(down, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(down.select("u", F.col("m").alias("v")))
        new = durable(small.where("u != v").distinct())
        if new.exceptAll(held).isEmpty() and held.exceptAll(new).isEmpty():
            break
        held = new
    roots = held.select(F.col("u").alias("_u"), F.col("v").alias("_root"))
    return named.join(roots, "_u", "left").withColumn("_root", F.coalesce("_root", "_u")).drop("_u", "_v")


# -- reports ------------------------------------------------------------------


def report(matched: DataFrame, columns: list[str], top: int = 5) -> DataFrame:
    """For each column: changed rows, their share of matched rows, and the most frequent old-to-new pairs."""
    both = matched.where("status in ('identical', 'changed')")
    total = both.agg(F.count(F.lit(1)).alias("matched"))
    cells = F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"`a_{c}`").cast("string").alias("old"), F.col(f"`b_{c}`").cast("string").alias("new"), F.col(f"`changed_{c}`").alias("hit")) for c in columns])
    pairs = both.select(F.inline(F.filter(cells, lambda x: x["hit"]))).groupBy("column", "old", "new").agg(F.count(F.lit(1)).alias("n"))
    best = Window.partitionBy("column").orderBy(F.col("n").desc(), "old", "new")
    ranked = pairs.withColumn("place", F.row_number().over(best))
    changed = pairs.groupBy("column").agg(F.sum("n").alias("changed"))
    tops = ranked.where(F.col("place") <= top).groupBy("column").agg(F.array_sort(F.collect_list(F.struct("place", "old", "new", "n"))).alias("top"))
    names = matched.sparkSession.createDataFrame([(c,) for c in columns], "column string")
    out = names.join(changed, "column", "left").join(tops, "column", "left").crossJoin(F.broadcast(total))
    return out.select("column", F.coalesce("changed", F.lit(0)).alias("changed"), F.coalesce(F.col("changed") / F.col("matched"), F.lit(0.0)).alias("share"), "top")


def side_totals(matched: DataFrame, column: str) -> DataFrame:
    """Sums and means of a number on each side, over all rows and over matched rows only."""
    a, b = finite(F.col(f"`a_{column}`")), finite(F.col(f"`b_{column}`"))
    both = F.col("status").isin("identical", "changed")
    return matched.agg(
        F.sum(a).alias("sum_a"), F.sum(b).alias("sum_b"), F.avg(a).alias("mean_a"), F.avg(b).alias("mean_b"),
        F.sum(F.when(both, a)).alias("matched_a"), F.sum(F.when(both, b)).alias("matched_b"),
    )


def diff_summary(diffs: DataFrame) -> DataFrame:
    """Of a table with ``diff``: rows, sum, mean, median, the reach that holds 95 %, the extremes."""
    x = F.col("diff")
    one = diffs.agg(F.count(x).alias("n"), F.sum(x).alias("sum"), F.avg(x).alias("mean"), F.min(x).alias("min"), F.max(x).alias("max"))
    one = with_quantiles(with_quantiles(one, diffs, x, [0.5], [], "_mid"), diffs, F.abs(x), [0.95], [], "_reach")
    return one.select("n", "sum", "mean", F.get("_mid", F.lit(0)).alias("median"), F.get("_reach", F.lit(0)).alias("p95_reach"), "min", "max")


def suggest_renames(a: DataFrame, b: DataFrame, left: list[str], right: list[str], least: float = 0.9, kinds: int = 20) -> DataFrame:
    """Pairs of differently named columns whose distinct values overlap by ``least`` (20 or more on both sides)."""
    def values(df: DataFrame, columns: list[str], name: str) -> DataFrame:
        cells = F.array(*[F.struct(F.lit(c).alias(name), F.col(f"`{c}`").cast("string").alias("v")) for c in columns])
        return df.select(F.inline(cells)).where("v is not null").distinct()

    va, vb = values(a, left, "a"), values(b, right, "b")
    na, nb = va.groupBy("a").agg(F.count(F.lit(1)).alias("na")), vb.groupBy("b").agg(F.count(F.lit(1)).alias("nb"))
    both = va.join(vb, "v").groupBy("a", "b").agg(F.count(F.lit(1)).alias("shared")).join(na, "a").join(nb, "b")
    overlap = F.col("shared") / F.least("na", "nb")
    return both.where((F.col("na") >= kinds) & (F.col("nb") >= kinds)).withColumn("overlap", overlap).where(F.col("overlap") >= least).select("a", "b", "overlap")


def letters(a: str, b: str) -> list[tuple[str, str]]:
    """A display of what changed between two cells: (``=``, ``-`` or ``+``, text) by the longest common subsequence."""
    n, m = len(a), len(b)
    table = [[0] * (m + 1) for _ in range(n + 1)]
    for i in range(n - 1, -1, -1):
        for j in range(m - 1, -1, -1):
            table[i][j] = table[i + 1][j + 1] + 1 if a[i].lower() == b[j].lower() else max(table[i + 1][j], table[i][j + 1])
    out: list[tuple[str, str]] = []

    def add(kind: str, ch: str) -> None:
        if out and out[-1][0] == kind:
            out[-1] = (kind, out[-1][1] + ch)
        else:
            out.append((kind, ch))

    i = j = 0
    while i < n or j < m:
        if i < n and j < m and a[i].lower() == b[j].lower():
            add("=", b[j])
            i, j = i + 1, j + 1
        elif j < m and (i == n or table[i][j + 1] >= table[i + 1][j]):
            add("+", b[j])
            j += 1
        else:
            add("-", a[i])
            i += 1
    return out
