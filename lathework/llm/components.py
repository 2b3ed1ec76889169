"""Connected components by alternating large-star and small-star.

Defined results: null ends and loops are dropped; repeated edges count once; a
node without an edge has no row; an empty table gives no row; other columns are
not carried; a node with any share of the edges is split (``skewed_join``).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, skewed_join, written


def _large(edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Each node's larger neighbours are tied to the smallest of its neighbours and itself."""
    both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = written(both.groupBy("u").agg(F.least("u", F.min("v")).alias("m"), F.count(F.lit(1)).alias("n")), "least")
    return skewed_join(both, least, "u", "n").where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v")), least


def _small(edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Each node and its smaller neighbours are tied to the smallest of these."""
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = written(down.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("n")), "least")
    tied = skewed_join(down, least, "u", "n").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return tied.unionByName(least.select("u", F.col("m").alias("v"))).where("u != v").distinct(), least


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """``node`` and ``component`` (the smallest node that it reaches) of every node in ``edges`` (u, v).

    Each round is written to the shared folder and the one before it removed;
    the rounds end when every edge leads to a node that leads nowhere, which a
    few rounds reach (the distance to the smallest node shrinks by a factor each
    round).
    """
    held = written(edges.where("u is not null and v is not null and u != v").select("u", "v").distinct(), "edges")
    for _ in range(rounds):
        wide, a = _large(held)
        wide = written(wide.where("u != v").distinct(), "edges")
        tied, b = _small(wide)
        tied = written(tied, "edges")
        for old in (held, a, wide, b):
            discard(old)
        held = tied
        # Settled: one edge from each node, and none to a node that has one.
        ends = held.select("u", F.lit(1).alias("out"), F.lit(0).alias("into")).unionByName(held.select(F.col("v").alias("u"), F.lit(0).alias("out"), F.lit(1).alias("into")))
        loose = ends.groupBy("u").agg(F.sum("out").alias("out"), F.max("into").alias("into")).where("out > 1 or out = 1 and into = 1")
        if loose.isEmpty():
            break
    else:
        raise RuntimeError(f"components not settled after {rounds} rounds")
    return held.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(
        held.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    )
