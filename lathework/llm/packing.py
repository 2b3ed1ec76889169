"""Best-fit-decreasing packing of token sequences, exact over the whole table.

Best-fit decreasing looks at lengths only, and no length exceeds the capacity,
so the whole table's packing follows from one count for each length: at most
``capacity`` numbers, whatever the table holds.  The plan is made from these on
the driver: lengths go from the longest down, a segment tree over the remaining
capacities finds the tightest open one in logarithmic time, and a run of bins
with equal rest takes a run of equal pieces at once.  Its result is the same as
placing piece after piece.  A run says: pieces ``rank`` .. of length ``length``
go, ``each`` to a bin, into the bins from ``bin`` on, from ``offset`` on.

Every piece then needs its rank among the pieces of its length.  Ranks are
counted in groups of (length, salt) with as many salts as a length's count asks
for, so a length that a third of all pieces have is spread over many tasks; the
groups' totals are summed up by blocks, and a group gets the runs that it meets.

Defined results: a null or empty text is a document of the end id alone; equal
rows are packed each; a piece never exceeds the capacity; an empty table gives
no piece; a text of any length is encoded whole and cut by ids only; columns other
than the id and the text are not carried, whatever their names.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import tokens
from .common import tidy, written

CAPACITY = 1024
END_ID = 2
#: Pieces of a group on average, and the runs up to which the plan is broadcast.
GROUP_ROWS, MOST_RUNS = 1_000, 50_000


class TightestOpen:
    """Segment tree over capacities 1..n: how many bins have each rest; the least rest that fits."""

    def __init__(self, n: int):
        self.size = 1
        while self.size <= n:
            self.size *= 2
        self.sums = [0] * (2 * self.size)

    def add(self, rest: int, bins: int) -> None:
        i = self.size + rest
        while i:
            self.sums[i] += bins
            i //= 2

    def find(self, least: int) -> int | None:
        """The smallest rest of at least ``least`` that an open bin has."""
        i = self.size + least
        if self.sums[i]:
            return least
        while i > 1:
            if i % 2 == 0 and self.sums[i + 1]:
                i += 1
                while i < self.size:
                    i = 2 * i if self.sums[2 * i] else 2 * i + 1
                return i - self.size
            i //= 2
        return None


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> tuple[list[tuple[int, int, int, int, int, int]], int]:
    """Runs (length, rank, pieces, each, bin, offset) and the number of bins, by best-fit decreasing."""
    tree = TightestOpen(capacity)
    open_bins: dict[int, list[tuple[int, int]]] = {}
    runs, bins = [], 0

    def put(rest: int, first: int, n: int) -> None:
        if rest and n:
            open_bins.setdefault(rest, []).append((first, n))
            tree.add(rest, n)

    for length in sorted((k for k, v in counts.items() if v), reverse=True):
        left, rank = counts[length], 0
        while left:
            rest = tree.find(length)
            if rest is None:
                rest = capacity
                first, n = bins, -(-left // (capacity // length))
                bins += n
            else:
                first, n = open_bins[rest].pop()
                tree.add(rest, -n)
            each = rest // length
            used = min(n, -(-left // each))
            put(rest, first + used, n - used)
            took = min(left, used * each)
            runs.append((length, rank, took, each, first, capacity - rest))
            full = took // each
            put(rest - each * length, first, full)
            if took % each:
                put(rest - (took % each) * length, first + full, 1)
            left -= took
            rank += took
    return runs, bins


def pieces(docs: DataFrame, key: str, text: str, path: str, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """One row for each piece of each document: key, piece, start, length, ids_crc32.

    The first piece of a longer document takes what is left over full ones.
    """
    kind = docs.schema[key].dataType.simpleString()

    def cut(batches):
        encode = tokens.encoder(path, True)
        end = int(end_id).to_bytes(4, "little")
        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                part = batch.slice(lo, 256)
                at, n, start, length, crc = [], [], [], [], []
                for row, text in enumerate(part.column(1).to_pylist()):
                    ids = encode.encode(text or "") + end
                    total = len(ids) // 4
                    first = total % capacity or min(total, capacity)
                    a, b, k = 0, first, 0
                    while a < total:
                        at.append(row)
                        n.append(k)
                        start.append(a)
                        length.append(b - a)
                        crc.append(zlib.crc32(ids[4 * a : 4 * b]))
                        a, b, k = b, b + capacity, k + 1
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column(0).take(pa.array(at, pa.int32())),
                        pa.array(n, pa.int32()),
                        pa.array(start, pa.int64()),
                        pa.array(length, pa.int64()),
                        pa.array(crc, pa.int64()),
                    ],
                    names=[key, "piece", "start", "length", "ids_crc32"],
                )
        tidy()

    schema = f"`{key}` {kind}, piece int, start bigint, length bigint, ids_crc32 bigint"
    return docs.select(F.col(key), F.col(text).cast("string")).mapInArrow(cut, schema)


def pack(rows: DataFrame, length: str = "length", capacity: int = CAPACITY, group_rows: int = GROUP_ROWS) -> DataFrame:
    """``rows`` with ``sequence_id`` and ``offset``; ``rows`` must read the same each time (a written table)."""
    spark = rows.sparkSession
    columns = rows.columns
    # At most capacity rows: one for each length.
    counts = {int(r[0]): int(r[1]) for r in rows.groupBy(length).count().collect()}
    runs, _ = plan(counts, capacity)
    # Each length has as many salts as its pieces need, so no group is large.
    sizes = F.create_map(*[F.lit(x) for n, c in counts.items() for x in (n, -(-c // group_rows))]) if counts else F.create_map(F.lit(0), F.lit(1))
    mark = F.xxhash64(*columns)
    salted = rows.withColumn("_mark", mark).withColumn("_salt", F.pmod("_mark", F.element_at(sizes, F.col(length).cast("int"))))
    groups = written(salted.groupBy(F.col(length).alias("_length"), "_salt").agg(F.count(F.lit(1)).alias("_n")), "pack-groups")
    firsts = _firsts(groups)
    by_length: dict[int, list[tuple[int, int, int, int, int]]] = {}
    for size, rank, took, each, first, offset in runs:
        by_length.setdefault(size, []).append((rank, took, each, first, offset))
    kind = "_size bigint, _runs array<struct<rank:bigint,took:bigint,each:bigint,bin:bigint,offset:bigint>>"
    lists = spark.createDataFrame(list(by_length.items()), kind)
    if len(runs) <= MOST_RUNS:
        lists = F.broadcast(lists)
    # A group gets the runs that its ranks lie in, so a piece looks through few of them.
    own = "filter(_runs, r -> r.rank < _first + _n and r.rank + r.took > _first)"
    firsts = firsts.join(lists, F.col("_length") == F.col("_size")).select("_length", F.col("_salt").alias("_of"), "_first", F.expr(own).alias("_own"))
    inner = Window.partitionBy(F.col(length), "_salt").orderBy("_mark", *[F.col(f"`{c}`") for c in columns])
    ranked = salted.withColumn("_in", F.row_number().over(inner) - 1)
    placed = ranked.join(firsts, (F.col(length) == F.col("_length")) & (F.col("_salt") == F.col("_of")))
    placed = placed.withColumn("_rank", F.col("_first") + F.col("_in")).withColumn("_run", F.expr("element_at(filter(_own, r -> r.rank <= _rank), -1)"))
    within = F.col("_rank") - F.col("_run.rank")
    return placed.select(
        *[F.col(f"`{c}`") for c in columns],
        (F.col("_run.bin") + F.floor(within / F.col("_run.each"))).cast("long").alias("sequence_id"),
        (F.col("_run.offset") + (within % F.col("_run.each")) * F.col(length)).cast("long").alias("offset"),
    )


def _firsts(groups: DataFrame, block: int = 4096) -> DataFrame:
    """``groups`` with ``_first``: the pieces of the same length in groups of smaller salt, summed by blocks of salts."""
    held = groups.withColumn("_block", F.floor(F.col("_salt") / block))
    blocks = held.groupBy("_length", "_block").agg(F.sum("_n").alias("_all"))
    upper = Window.partitionBy("_length").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    inner = Window.partitionBy("_length", "_block").orderBy("_salt").rowsBetween(Window.unboundedPreceding, -1)
    zero = F.lit(0)
    blocks = blocks.select("_length", "_block", F.coalesce(F.sum("_all").over(upper), zero).alias("_before"))
    joined = held.withColumn("_within", F.coalesce(F.sum("_n").over(inner), zero)).join(blocks, ["_length", "_block"])
    return joined.select("_length", "_salt", "_n", (F.col("_before") + F.col("_within")).alias("_first"))


def pack_documents(docs: DataFrame, key: str = "doc_id", text: str = "text", path: str | None = None, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """Cut and pack: key, piece, start, length, ids_crc32, sequence_id, offset."""
    path = path or tokens.default_path("byte_bpe_50k.json")
    return pack(written(pieces(docs, key, text, path, capacity, end_id), "pieces"), "length", capacity)


def sequences(docs: DataFrame, packed: DataFrame, key: str = "doc_id", text: str = "text", path: str | None = None, end_id: int = END_ID) -> DataFrame:
    """The packed sequences themselves: sequence_id and its ids, little-endian unsigned 32-bit.

    Needs unique keys.  A sequence holds ``capacity`` ids at most, so a group is small.
    """
    path = path or tokens.default_path("byte_bpe_50k.json")
    places = packed.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("start", "length", "sequence_id", "offset"))).alias("places"))

    def fill(batches):
        encode = tokens.encoder(path, True)
        end = int(end_id).to_bytes(4, "little")
        for batch in batches:
            out = ([], [], [])
            for text, cuts in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                ids = encode.encode(text or "") + end
                for c in cuts:
                    out[0].append(c["sequence_id"])
                    out[1].append(c["offset"])
                    out[2].append(ids[4 * c["start"] : 4 * (c["start"] + c["length"])])
            yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.binary())], names=["sequence_id", "offset", "ids"])

    filled = docs.join(places, key).select(text, "places").mapInArrow(fill, "sequence_id bigint, offset bigint, ids binary")
    joined = F.array_sort(F.collect_list(F.struct("offset", "ids")))
    return filled.groupBy("sequence_id").agg(F.aggregate(joined, F.lit(b"").cast("binary"), lambda a, x: F.concat(a, x["ids"])).alias("ids"))


def ids_of(row: bytes) -> np.ndarray:
    """A sequence's ids."""
    return np.frombuffer(row, "<u4")
