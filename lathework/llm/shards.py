"""Sharding by a two-pass external shuffle.

Pass 1 scatters the records uniformly into buckets of about ``bucket_bytes`` by
a seeded hash of the id and the text: Spark's shuffle is the external store.
Pass 2 orders each bucket by its rows (so that a retried task meets them in the
same order), applies a Fisher-Yates shuffle seeded by the bucket, and writes it.
The buckets' sizes, summed up, give each record its place in one random order
of the whole table; the shards are equal slices of that order (law ``rows``:
their counts differ by one at most).

A bucket is held in memory by one task; its size does not depend on the table.
The hash takes the id and the text, so copies of one text under different ids
spread over all buckets; only rows equal in both share one.

Defined results: nulls hash as values of their own; equal rows are placed each;
a text of any length is one record; an empty table gives an empty result; other
columns are written along, whatever their names.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import prefix_sums, scratch, small_batches

SHARDS = 16
BUCKET_BYTES = 32 << 20


def fisher_yates(n: int, seed: tuple[int, ...]) -> np.ndarray:
    """A random order of 0..n-1: numpy's permutation is a Fisher-Yates shuffle."""
    return np.random.default_rng(seed).permutation(n)


def place(position, n, shards: int):
    """(shard, slot) of a place in the order; the first ``n % shards`` shards take one row more."""
    base, more = F.floor(n / shards), n % shards
    edge = more * (base + 1)
    long_shard = F.floor(position / (base + 1))
    short_shard = more + F.floor(F.try_divide(position - edge, base))
    shard = F.when(position < edge, long_shard).otherwise(short_shard)
    slot = F.when(position < edge, position - long_shard * (base + 1)).otherwise(position - edge - (short_shard - more) * base)
    return shard.cast("int"), slot.cast("long")


def shuffle(docs: DataFrame, key: str = "doc_id", text: str = "text", shards: int = SHARDS, seed: int = 17, bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """``docs`` in a random order, with ``shard`` and ``slot`` (columns of these names are replaced)."""
    docs = docs.drop("shard", "slot", "_bucket", "_first", "_position")
    body = F.coalesce(F.octet_length(text), F.lit(0)) + 64
    # Two numbers reach the driver: the bytes decide the number of buckets, the rows the shards' sizes.
    sums = docs.agg(F.sum(body).alias("b"), F.count(F.lit(1)).alias("n")).first()
    n, buckets = int(sums["n"]), max(1, -(-int(sums["b"] or 0) // bucket_bytes))
    mark = F.pmod(F.xxhash64(F.lit(seed), F.col(key), F.col(text)), F.lit(buckets)).cast("int")
    counts = docs.groupBy(mark.alias("_bucket")).agg(F.count(F.lit(1)).alias("_n"))
    dense = docs.sparkSession.range(buckets).select(F.col("id").cast("int").alias("_bucket")).join(counts, "_bucket", "left")
    firsts = prefix_sums(dense.select("_bucket", F.coalesce("_n", F.lit(0)).alias("_n")), "_bucket", "_n")
    # A bucket's first place travels with its rows, as a row that sorts before them: no join moves the texts.
    columns = docs.columns
    heads = firsts.select("_bucket", F.col("before").alias("_first"))
    mixed = docs.withColumn("_bucket", mark).unionByName(heads, allowMissingColumns=True)
    mixed = mixed.repartitionById(buckets, F.col("_bucket")).sortWithinPartitions(
        "_bucket", F.col("_first").desc_nulls_last(), F.col(key), F.xxhash64(text)
    )
    mixed = mixed.select(*[F.col(f"`{c}`") for c in columns], "_bucket", "_first")
    out_schema = docs.limit(0).withColumn("_position", F.lit(0).cast("long")).schema

    def second_pass(batches):
        held: list[pa.RecordBatch] = []
        current = None

        def dealt():
            rows = pa.Table.from_batches(held)
            first = rows.column("_first")[0].as_py()
            rows = rows.slice(1).select(columns)
            # The row at place i of the bucket's order is row order[i].
            order = fisher_yates(rows.num_rows, (seed, current))
            places = pa.array(first + np.arange(rows.num_rows, dtype=np.int64))
            yield from rows.take(pa.array(order)).append_column("_position", places).to_batches(max_chunksize=2000)

        for batch in batches:
            marks = batch.column(batch.schema.get_field_index("_bucket")).to_numpy(zero_copy_only=False)
            cuts = [0, *(np.flatnonzero(np.diff(marks)) + 1).tolist(), len(marks)]
            for a, b in zip(cuts, cuts[1:], strict=False):
                if a == b:
                    continue
                if current is not None and marks[a] != current:
                    yield from dealt()
                    held = []
                current = int(marks[a])
                held.append(batch.slice(a, b - a))
        if held:
            yield from dealt()

    shard, slot = place(F.col("_position"), F.lit(n), shards)
    return mixed.mapInArrow(second_pass, out_schema).select(
        *[F.col(f"`{c}`") for c in columns], shard.alias("shard"), slot.alias("slot")
    )


def write_shards(docs: DataFrame, path: str, key: str = "doc_id", text: str = "text", shards: int = SHARDS, seed: int = 17) -> None:
    """Write the shuffled table: a folder ``shard=k`` for each shard, rows in the order of their slots."""
    shuffle(docs, key, text, shards, seed).write.mode("overwrite").option("compression", "zstd").partitionBy("shard").parquet(path)


def read_shards(spark, path: str) -> DataFrame:
    return spark.read.parquet(path)


def sharded(docs: DataFrame, key: str = "doc_id", text: str = "text", shards: int = SHARDS, seed: int = 17) -> DataFrame:
    """The shards written to the shared folder and read again: the columns of ``docs``, ``slot`` and ``shard``."""
    docs = docs.drop("shard", "slot")
    path = scratch(docs.sparkSession, "shards")
    with small_batches(docs.sparkSession):
        write_shards(docs, path, key, text, shards, seed)
    schema = docs.limit(0).withColumn("slot", F.lit(0).cast("long")).withColumn("shard", F.lit(0)).schema
    return docs.sparkSession.read.schema(schema).parquet(path)
