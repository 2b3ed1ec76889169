"""A stored index of a column's words and values: fuzzy search, search by sound, type-ahead.

``build`` writes three tables under a path, each partitioned by ``part``, a hash
of what it is asked by, so that a search reads the folders of its own keys only:

* ``keys``      key -> the different words of the column that have it.  A word
                has its letter pairs, its letters (as ``1:x``), its first one and
                two letters (``^:xy``) and its Double Metaphone codes (``~:KT``).
* ``postings``  word -> the different values that hold it.
* ``values``    key -> value, its normal form and how many rows have it, for
                type-ahead; the keys are the normal form's letters and pairs.

Words and values are held once, whatever their rows; a search ends in a semi-join
of the rows with the values that it found.  Within a part, rows of one key are
spread by ``repartition`` over ``PARTS`` and split by size, so a frequent pair is
no single task.

Defined results: null and blank cells have no word and no value; a query without
a word finds every row (fuzzy, by sound) or nothing (type-ahead); an empty table
gives empty tables; a cell of any length is split whole; columns of other names
are not read.
"""

from __future__ import annotations

import dataclasses

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import phonetics
from ..functions import text as T
from .filters import LEVELS

PARTS = 64


def _part(c: Column) -> Column:
    return F.pmod(F.xxhash64(c), F.lit(PARTS)).cast("int")


def _pairs(c: Column) -> Column:
    n = F.char_length(c)
    return F.when(n > 1, F.transform(F.sequence(F.lit(1), F.greatest(n - 1, F.lit(1))), lambda i: F.substring(c, i, F.lit(2)))).otherwise(F.array().cast("array<string>"))


def _letters(c: Column) -> Column:
    return F.transform(F.filter(F.split(c, ""), lambda x: x != ""), lambda x: F.concat(F.lit("1:"), x))


@dataclasses.dataclass(frozen=True)
class FuzzyIndex:
    """The written tables at ``path``; open one again with ``FuzzyIndex(spark, path)``."""

    spark: SparkSession
    path: str

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/{name}")

    def lookup(self, name: str, keys: list[str], key: str = "key") -> DataFrame:
        """Rows of the given keys: ``part`` is folded to numbers, so only their folders are listed."""
        return self.table(name).where(F.col("part").isin([_part(F.lit(k)) for k in keys]) & F.col(key).isin(keys))


def build(df: DataFrame, column: str, path: str) -> FuzzyIndex:
    """Write the index of ``column``."""
    cells = df.select(F.col(f"`{column}`").cast("string").alias("value")).where("trim(value) <> ''").groupBy("value").agg(F.count(F.lit(1)).alias("n"))
    cells = cells.withColumn("norm", T.normalize(F.col("value")))
    held = cells.select("value", F.explode(F.array_distinct(T.tokens(F.col("value")))).alias("word"))
    word = F.col("word")
    starts = F.array(F.concat(F.lit("^:"), F.left(word, F.lit(1))), F.concat(F.lit("^:"), F.left(word, F.lit(2))))
    sounds = F.transform(phonetics.codes_udf(word), lambda x: F.concat(F.lit("~:"), x))
    keys = held.select("word").distinct().select("word", F.explode(F.array_distinct(F.concat(_pairs(word), _letters(word), starts, sounds))).alias("key"))
    norm = F.col("norm")
    values = cells.select("value", "norm", "n", F.explode(F.array_distinct(F.concat(_pairs(norm), _letters(norm)))).alias("key"))
    for name, table, by in (("keys", keys, "key"), ("postings", held, "word"), ("values", values, "key")):
        placed = table.withColumn("part", _part(F.col(by)))
        placed.hint("rebalance", F.col("part")).write.mode("overwrite").partitionBy("part").parquet(f"{path}/{name}")
    return FuzzyIndex(df.sparkSession, path)


def candidates(index: FuzzyIndex, q: str, reach: int = 2) -> DataFrame:
    """``word``: those that share enough letter pairs with ``q`` and are about as long, or begin with it."""
    pairs = list(dict.fromkeys(q[i : i + 2] for i in range(len(q) - 1)))
    start = f"^:{q[:2]}"
    votes = index.lookup("keys", [*pairs, start]).groupBy("word").agg(F.count_if(F.col("key") != start).alias("votes"))
    near = (F.abs(F.char_length("word") - len(q)) <= reach) & (F.col("votes") >= max(1, len(pairs) - 2 * reach))
    return votes.where(near | F.col("word").startswith(q)).select("word")


def _matched(index: FuzzyIndex, q: str, level: str) -> DataFrame:
    """The words that match a word of the query."""
    word = F.col("word")
    if len(q) == 1:
        return index.lookup("keys", [f"1:{q}"]).select("word")
    if len(q) == 2:
        return index.lookup("keys", [q]).select("word")
    found = candidates(index, q).withColumn("begins", word.startswith(q))
    # Only words that do not begin with the query go through Python.
    alike = found.where(~F.col("begins")).where(T.jaro_winkler_udf(word, F.lit(q)) >= LEVELS[level])
    return found.where("begins").select("word").unionByName(alike.select("word"))


def _values_of(index: FuzzyIndex, words: list[DataFrame]) -> DataFrame | None:
    """The values that hold a word of each list."""
    out = None
    for found in words:
        held = index.table("postings").join(found.withColumn("part", _part(F.col("word"))), ["part", "word"]).select("value").distinct()
        out = held if out is None else out.join(held, "value", "left_semi")
    return out


def _rows(df: DataFrame, column: str, values: DataFrame | None) -> DataFrame:
    return df if values is None else df.join(values, df[column].cast("string") == values["value"], "left_semi")


def fuzzy(df: DataFrame, column: str, index: FuzzyIndex, query: str, level: str = "normal") -> DataFrame:
    """Rows where each word of the query matches some word of the cell: ``filters.fuzzy`` through the index."""
    return _rows(df, column, _values_of(index, [_matched(index, q, level) for q in T.query_words(query)]))


def phonetic(df: DataFrame, column: str, index: FuzzyIndex, query: str, fall_back: bool = True) -> DataFrame:
    """Rows where each word of the query has a code of some word of the cell; by spelling if there is none."""
    words = T.query_words(query)
    values = _values_of(index, [index.lookup("keys", [f"~:{c}" for c in set(phonetics.double_metaphone(q)) if c] or ["~:"]).select("word").distinct() for q in words])
    if fall_back and values is not None and values.isEmpty():
        return fuzzy(df, column, index, query)
    return _rows(df, column, values)


def suggestions(index: FuzzyIndex, query: str, limit: int = 10) -> DataFrame:
    """``value``, ``n``, ``score``: the value itself (4), those that begin with the query (3), hold it (2), or are alike and share a letter pair."""
    q = T.normalize_full(query)
    keys = list(dict.fromkeys(q[i : i + 2] for i in range(len(q) - 1))) or [f"1:{c}" for c in q]
    found = index.lookup("values", keys or ["1:"]).select("value", "norm", "n").distinct()
    norm = F.col("norm")
    score = F.when(norm == q, 4.0).when(norm.startswith(q), 3.0).when(norm.contains(q), 2.0)
    sure = found.withColumn("score", score).where("score is not null")
    alike = found.where(score.isNull()).withColumn("score", T.jaro_winkler_udf(norm, F.lit(q))).where(F.col("score") >= LEVELS["loose"])
    return sure.unionByName(alike).select("value", "n", "score").orderBy(F.desc("score"), F.desc("n"), "value").limit(limit)
