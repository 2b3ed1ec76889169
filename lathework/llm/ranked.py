"""Ranked lexical search: a stored inverted index in order of impact, searched by TPUT.

``build`` writes two tables in the shared folder:

* ``docs``      one row for each document with a term: ``row`` (its number),
                ``doc_id``, ``n`` (terms with repeats) and its ``terms`` with
                their counts ``tfs``;
* ``postings``  ``term``, ``segment``, ``most`` and the lists ``impacts`` and
                ``rows``, by falling impact and rising row: a term's part of one
                segment (about ``SEGMENT`` postings of documents that one task
                reads).  A segment is inverted where it is read, so what is
                shuffled is one row for each term and segment; rows of one term
                are put together and large partitions split, so a term of any
                share of the documents spreads like any other.

The impact of a term that occurs ``tf`` times in a document is
``(1000000000 tf) div (1000 tf + 12 m)`` with ``m = 75 + (25 n N) div L``, and
its part of a score the impact times the query's repeats times the weight
``floor(1000 ln((2N + 2) / (2 df + 1)))``.

``search`` finds the exact ``k`` best documents of every item in three phases
(three-phase uniform threshold):

1. The ``k`` highest impacts of every asked list are fetched.  The documents with
   an item's ``2k`` best sums of fetched parts are looked up, and the k-th best of
   their scores is a lower bound of its k-th best score.
2. ``SHARE`` of that bound over the number of the item's terms is one threshold
   for all its lists (a lower one fetches more entries and leaves fewer
   look-ups).  The segments whose lists reach it are fetched and each segment
   adds up the entries at or over it; a document stays if its sum and the most
   that its unseen parts can give (less than the threshold, or the list's head
   if that is lower) reach the bound, which the k-th best sum then raises.
3. The documents that are left are looked up in ``docs`` for their exact scores.

Query terms go to the executors in blocks of at most ``BLOCK_BYTES`` (an item is
never split).  Terms are the runs of ``[0-9A-Za-z]`` and of characters beyond
ASCII, A-Z lower-cased.

Defined results: a null or empty text, or one without a term, is no document; an
item without terms, or of which no document has a term of positive weight, has
no row; every row is a document, and every item row an item, of its own, also
with an id that repeats or is null; equal scores are ordered by doc_id, then by
row; empty tables give no row; texts of any length are taken whole (one row of
``docs`` holds a document's different terms); other columns, whatever their
names, are not carried.
"""

from __future__ import annotations

import collections
import dataclasses

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import slices, small_batches, written
from .decontam import words

BLOCK_BYTES = 8 << 20
SHARE = 0.125
SEGMENT = 1 << 20
#: Impacts are under 2 to the power of this.
BITS = 20


@dataclasses.dataclass(frozen=True)
class Index:
    docs: DataFrame
    postings: DataFrame
    n: int
    length: int


def _counted(docs: DataFrame, key: str, text: str) -> DataFrame:
    """``row``, ``doc_id``, ``n``, ``terms``, ``tfs`` of the rows with a term."""

    def count(batches):
        from pyspark import TaskContext

        row = TaskContext.get().partitionId() << 33
        for batch in slices(batches):
            ids, rows, lengths, terms, tfs, ends = [], [], [], [], [], [0]
            for i, t in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                found = words(t.as_py())
                row += 1
                if not found:
                    continue
                held = collections.Counter(found)
                ids.append(i)
                rows.append(row)
                lengths.append(len(found))
                terms += held
                tfs += held.values()
                ends.append(len(tfs))
            offsets = pa.array(ends, pa.int32())
            yield pa.RecordBatch.from_arrays(
                [pa.array(rows, pa.int64()), pa.array(ids, pa.int64()), pa.array(lengths, pa.int64()), pa.ListArray.from_arrays(offsets, pa.array(terms, pa.binary()).cast(pa.string())), pa.ListArray.from_arrays(offsets, pa.array(tfs, pa.int64()))],
                ["row", "doc_id", "n", "terms", "tfs"],
            )

    return docs.select(F.col(key).cast("long"), text).mapInArrow(count, "row bigint, doc_id bigint, n bigint, terms array<string>, tfs array<bigint>")


def impacts(tf, n, docs: int, length: int):
    """In 64-bit integers, of numbers, arrays or Columns (whose division is then ``div``)."""
    if isinstance(tf, Column):
        return F.expr(f"(1000000000L * tf) div (1000L * tf + 12L * (75L + ((25L * n * {docs}L) div {max(length, 1)}L)))")
    return 1_000_000_000 * tf // (1000 * tf + 12 * (75 + 25 * n * docs // max(length, 1)))


def _inverted(held: DataFrame, docs: int, length: int, segment: int) -> DataFrame:
    """The segments' lists of ``held`` (row, n, terms, tfs)."""

    def lists(terms: pa.Array, rows: np.ndarray, value: np.ndarray, number: int) -> pa.RecordBatch:
        named = terms.dictionary_encode()
        codes = named.indices.to_numpy().astype(np.int64)
        place = len(codes).bit_length()
        if len(named.dictionary).bit_length() + BITS + place < 64:  # term, falling impact and place in one number
            order = np.sort(codes << (BITS + place) | ((1 << BITS) - 1 - value) << place | np.arange(len(codes))) & ((1 << place) - 1)
        else:
            order = np.lexsort([-value, codes])
        ends = pa.array(np.concatenate([[0], np.cumsum(np.bincount(codes, minlength=len(named.dictionary)))]), pa.int32())
        value, rows = value[order], rows[order]
        return pa.RecordBatch.from_arrays(
            [named.dictionary, pa.array(np.full(len(named.dictionary), number)), pa.array(value[np.asarray(ends)[:-1]]), pa.ListArray.from_arrays(ends, pa.array(value)), pa.ListArray.from_arrays(ends, pa.array(rows))],
            ["term", "segment", "most", "impacts", "rows"],
        )

    def invert(batches):
        from pyspark import TaskContext

        number, parts, size = TaskContext.get().partitionId() << 33, [], 0

        def flush():
            nonlocal parts, size, number
            out = lists(pa.concat_arrays([p[0] for p in parts]), np.concatenate([p[1] for p in parts]), np.concatenate([p[2] for p in parts]), number)
            parts, size, number = [], 0, number + 1
            for lo in range(0, out.num_rows, 4096):
                yield out.slice(lo, 4096)

        for batch in slices(batches, 1024):
            each = batch.column(3).value_lengths().to_numpy()
            tf, n = batch.column(3).flatten().to_numpy(), np.repeat(batch.column(1).to_numpy(), each)
            parts.append((batch.column(2).flatten(), np.repeat(batch.column(0).to_numpy(), each), impacts(tf, n, docs, length)))
            size += len(tf)
            if size >= segment:
                yield from flush()
        if size:
            yield from flush()

    return held.select("row", "n", "terms", "tfs").mapInArrow(invert, "term string, segment bigint, most bigint, impacts array<bigint>, rows array<bigint>")


def build(docs: DataFrame, key: str = "doc_id", text: str = "text", segment: int = SEGMENT) -> Index:
    """The index of all documents and all terms."""
    held = written(_counted(docs, key, text), "ranked-docs")
    n, length = held.agg(F.count(F.lit(1)), F.coalesce(F.sum("n"), F.lit(0))).first()
    with small_batches(docs.sparkSession):
        lists = _inverted(held, n, length, segment).hint("rebalance", F.col("term")).sortWithinPartitions("term", "segment")
    return Index(held, written(lists, "ranked-postings"), n, length)


def _kth(sums: DataFrame, value: str, k: int) -> DataFrame:
    """The k-th largest value of each item that has as many."""
    at = F.row_number().over(Window.partitionBy("item").orderBy(F.desc(value)))
    return sums.select("item", value, at.alias("at")).where(F.col("at") <= k).where(F.col("at") == k).select("item", F.col(value).alias("kth"))


def query_terms(items: DataFrame, key: str = "item_id", text: str = "text") -> DataFrame:
    """``item`` (a number for each row), ``item_id``, ``term``, ``q`` (its repeats)."""

    def count(batches):
        from pyspark import TaskContext

        row = TaskContext.get().partitionId() << 33
        for batch in slices(batches):
            at, numbers, terms, times = [], [], [], []
            for i, t in enumerate(batch.column(1)):
                row += 1
                for term, q in collections.Counter(words(t.as_py())).items():
                    at.append(i)
                    numbers.append(row)
                    terms.append(term)
                    times.append(q)
            yield pa.RecordBatch.from_arrays([pa.array(numbers, pa.int64()), batch.column(0).take(pa.array(at, pa.int64())), pa.array(terms, pa.binary()).cast(pa.string()), pa.array(times, pa.int64())], ["item", "item_id", "term", "q"])

    kind = items.schema[key].dataType.simpleString()
    return items.select(key, text).mapInArrow(count, f"item bigint, item_id {kind}, term string, q bigint")


def search(index: Index, items: DataFrame, k: int = 20, key: str = "item_id", text: str = "text", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """``item_id``, ``rank`` (from 1), ``doc_id``, ``score`` of each item's ``k`` best documents with a score above 0."""
    with small_batches(items.sparkSession):
        asked = written(query_terms(items, key, text), "asked")
        size = asked.agg(F.coalesce(F.sum(F.octet_length("term") + 64), F.lit(0))).first()[0]
        blocks = max(1, -(-size // block_bytes))
        out = [_search(index, asked.where(F.pmod(F.xxhash64("item"), F.lit(blocks)) == b) if blocks > 1 else asked, k) for b in range(blocks)]
    found = out[0]
    for more in out[1:]:
        found = found.unionByName(more)
    return found


def _search(index: Index, asked: DataFrame, k: int) -> DataFrame:
    """The three phases for a block of items."""
    n, length = index.n, index.length
    # Document frequencies and the largest impact of every asked list.
    lists = index.postings.join(F.broadcast(asked.select("term").distinct()), "term")
    known = lists.groupBy("term").agg(F.sum(F.size("rows")).alias("df"), F.max("most").alias("most"))
    weight = F.floor(1000 * F.log((2 * F.lit(float(n)) + 2) / (2 * F.col("df") + 1)))
    weighed = asked.join(F.broadcast(known), "term").withColumn("weight", (F.col("q") * weight).cast("long")).where((F.col("weight") > 0) & (F.col("most") > 0))
    asked = written(weighed.select("item", "item_id", "term", "weight", "most"), "weighed")

    def scored(left: DataFrame) -> DataFrame:
        """Exact scores of (item, row)."""
        few = F.broadcast(left) if left.count() * 32 <= BLOCK_BYTES else left
        found = index.docs.join(few, "row").select("item", "row", "doc_id", "n", F.inline(F.arrays_zip("terms", "tfs"))).toDF("item", "row", "doc_id", "n", "term", "tf")
        exact = found.join(F.broadcast(asked.select("item", "item_id", "term", "weight")), ["item", "term"])
        value = F.col("weight") * impacts(F.col("tf"), F.col("n"), n, length)
        return exact.groupBy("item", "row").agg(F.first("item_id").alias("item_id"), F.first("doc_id").alias("doc_id"), F.sum(value).alias("score"))

    # 1: the heads.
    every = F.broadcast(asked.select("term").distinct())
    heads = index.postings.join(every, "term").select("term", F.inline(F.arrays_zip(F.slice("impacts", 1, k).alias("impact"), F.slice("rows", 1, k).alias("row")))).toDF("term", "impact", "row")
    head = F.row_number().over(Window.partitionBy("term").orderBy(F.desc("impact"), "row"))
    heads = heads.withColumn("at", head).where(F.col("at") <= k)
    parts = heads.join(F.broadcast(asked.select("item", "term", "weight")), "term").groupBy("item", "row").agg(F.sum(F.col("weight") * F.col("impact")).alias("got"))
    best = F.row_number().over(Window.partitionBy("item").orderBy(F.desc("got"), "row"))
    tried = written(parts.withColumn("at", best).where(F.col("at") <= 2 * k).select("item", "row"), "tried")
    bound = {r["item"]: r["kth"] for r in _kth(scored(tried), "score", k).collect()}  # one for each item of the block

    # 2: one threshold for all lists of an item.
    block = asked.select("item", "term", "weight", "most").toArrow()
    names = block["term"].combine_chunks().dictionary_encode()
    item, term = block["item"].to_numpy(), names.indices.to_numpy()
    weights, most = block["weight"].to_numpy(), block["most"].to_numpy()
    items, of, terms = np.unique(item, return_inverse=True, return_counts=True)
    least_score = np.array([bound.get(i, 0) for i in items.tolist()], np.int64)
    bar = np.maximum(np.ceil(SHARE * least_score / np.maximum(terms, 1)), 1).astype(np.int64)[of]
    rest = np.minimum(bar - 1, weights * most)
    least = -(-bar // weights)
    order = np.argsort(of, kind="stable")
    starts = np.searchsorted(of[order], np.arange(len(items) + 1))
    number = {name: i for i, name in enumerate(names.dictionary.to_pylist())}

    def add_up(table: pa.Table) -> pa.Table:
        lists = {number[name]: i for i, name in enumerate(table["term"].to_pylist())}
        values, rows = table["impacts"].combine_chunks(), table["rows"].combine_chunks()
        ends = np.concatenate([[0], np.cumsum(values.value_lengths().to_numpy())])
        values, rows = values.flatten().to_numpy(), rows.flatten().to_numpy()
        different, rows = np.unique(rows, return_inverse=True)
        span = len(different)
        kept, whose, sums, most_sums = [], [], [], []
        for i, name in enumerate(items):
            got, seen, some = np.zeros(span), np.zeros(span), False
            for j in order[starts[i] : starts[i + 1]]:
                at = lists.get(term[j])
                if at is None:
                    continue
                lo = ends[at]
                hi = lo + np.searchsorted(-values[lo : ends[at + 1]], -least[j], "right")  # falling impacts
                got[rows[lo:hi]] += values[lo:hi] * weights[j]
                seen[rows[lo:hi]] += rest[j]
                some |= hi > lo
            if some:
                reach = got + (rest[order[starts[i] : starts[i + 1]]].sum() - seen)
                stay = np.flatnonzero((got > 0) & (reach * (1 + 1e-9) >= least_score[i]))
                kept.append(different[stay])
                whose.append(np.full(len(stay), name))
                sums.append(got[stay])
                most_sums.append(reach[stay])
        kinds = {"item": (whose, np.int64), "row": (kept, np.int64), "got": (sums, np.float64), "reach": (most_sums, np.float64)}
        return pa.table({c: np.concatenate(v) if v else np.empty(0, kind) for c, (v, kind) in kinds.items()})

    lowest = np.full(len(number), np.iinfo(np.int64).max)
    np.minimum.at(lowest, term, least)
    bars = pa.table({"term": names.dictionary, "lowest": lowest})
    spark = asked.sparkSession
    near = index.postings.join(F.broadcast(spark.createDataFrame(bars)), "term").where("most >= lowest")
    left = written(near.select("segment", "term", "impacts", "rows").groupBy("segment").applyInArrow(add_up, "item bigint, row bigint, got double, reach double"), "summed")
    kth = F.broadcast(_kth(left, "got", k))  # one row for each item of the block
    # Sums in doubles: exact below 2 to the power of 53, so the test leaves more than their rounding.
    left = written(left.join(kth, "item", "left").where(F.coalesce(F.col("reach") * (1 + 1e-9) >= F.col("kth"), F.lit(True))).select("item", "row"), "left")

    # 3: exact scores.
    rank = F.row_number().over(Window.partitionBy("item").orderBy(F.desc("score"), "doc_id", "row"))
    return written(scored(left).where("score > 0").withColumn("rank", rank).where(F.col("rank") <= k).select("item_id", "rank", "doc_id", "score"), "ranked")
