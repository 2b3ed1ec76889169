"""Benchmark decontamination with a stored, distributed positional inverted index.

The index is partitioned by document: each segment holds the postings of about a
megabyte of text (the arrangement of web search engines), so building it needs
no shuffle and each segment is searched where it lies.  It is written once, with
all terms, and can be read and searched again.  A segment row has

* ``segment``    its number,
* ``key``        the row keys of its documents, in order, and ``n_words`` of each,
* ``bases``      where each document starts in the segment's position space;
                 documents are ``GAP`` positions apart so no match crosses one,
* ``terms``      the terms, sorted, and ``offsets`` into ``postings``,
* ``postings``   the positions of each term, ascending, as differences.

A search takes a block of items.  Each window (``WINDOW`` words of an item; a
shorter item is one) has an anchor: its rarest term by the counts of the whole
index, the first of equal ones.  The anchor's postings are the candidates; they
are intersected with the lists of the terms beside it, shifted by the offsets,
to both sides until one fails.  All windows and candidates of a segment go
together as arrays (in slices of ``CANDIDATES``), and the lists of a term are
laid out over the positions, so that a step of the intersection is one look-up
for each candidate that is left.

* Exact: the run of consecutive matches through a candidate is as long as the
  window; then each of its words is hit.
* Proximity: every term of the window lies within ``SLOP`` words of its place
  beside the anchor.

Words are the runs of ``[0-9a-z\\x80-...]`` after A-Z are lower-cased.

The benchmark is the stated query set: it is taken to the executors in blocks
of at most ``block_bytes``, each searched over the stored index in the same way,
and only documents with a match travel on; so nothing that is broadcast grows
with the data.

Defined results: a null or empty text, or one without words, has no hits and is
not contaminated; an item without words has no window; rows with the same id
are judged one by one; a null item text or id is skipped (null id) or has no
window; an empty benchmark leaves every document clean; a null key is kept; a
text of any length is indexed and searched whole, in one segment;
``decontaminate`` carries other columns, whatever their names; an empty table
gives no row.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices, small_batches, tidy, written

WINDOW = 13
GAP = 64
SLOP = 3
SEGMENT_BYTES = 1 << 20
BLOCK_BYTES = 8 << 20
CANDIDATES = 1 << 18

#: Bytes of words stay (A-Z lower-cased), all others become a space.
_FOLD = bytes(
    b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256)
)

_SEGMENT = "segment bigint, key array<bigint>, n_words array<int>, bases binary, terms array<binary>, offsets binary, postings binary"


def words(text: str | None) -> list[bytes]:
    """The words of a text, as UTF-8."""
    return (text or "").encode("utf-8", "surrogatepass").translate(_FOLD).split()


def windows(text: str | None, size: int = WINDOW) -> list[tuple[bytes, ...]]:
    """Every run of ``size`` words; a shorter item is one window, an empty one has none."""
    w = words(text)
    if not w:
        return []
    return [tuple(w[i : i + size]) for i in range(max(1, len(w) - size + 1))]


class _Numbers(dict):
    """A number for each different word, in the order that they come."""

    def __missing__(self, word: bytes) -> int:
        n = self[word] = len(self)
        return n


class _Segment:
    """A segment in the making."""

    def __init__(self):
        self.keys: list[int | None] = []
        self.texts: list[bytes] = []
        self.bytes = 0

    def add(self, key: int | None, text: str | None) -> None:
        self.keys.append(key)
        self.texts.append((text or "").encode("utf-8", "surrogatepass"))
        self.bytes += len(text or "") + 64

    def batch(self, number: int, gap: int) -> pa.RecordBatch:
        # All texts at once, a space before and after each: words begin and end where space and word meet.
        folded = (b" " + b" ".join(self.texts) + b" ").translate(_FOLD)
        solid = np.frombuffer(folded, np.uint8) != 32
        turns = np.flatnonzero(solid[1:] != solid[:-1])
        first = turns[0::2]
        ends = np.cumsum([len(t) + 1 for t in self.texts])
        counts = np.diff(np.searchsorted(first, ends), prepend=0)
        bases = np.zeros(len(counts), np.int64)
        np.cumsum(counts[:-1] + gap, out=bases[1:])
        cuts = np.zeros(len(first) + 1, np.int32)
        np.cumsum(turns[1::2] - first, out=cuts[1:])
        body = folded.translate(None, b" ")
        found = pa.Array.from_buffers(pa.binary(), len(first), [None, pa.py_buffer(cuts), pa.py_buffer(body)]).dictionary_encode()
        order = pc.sort_indices(found.dictionary)
        rank = np.empty(len(order), np.int64)
        rank[order.to_numpy()] = np.arange(len(order))
        codes = rank[found.indices.to_numpy()]
        places = np.arange(len(codes)) + np.repeat(np.arange(len(counts)) * gap, counts)
        # By term and place in one sort.
        postings = np.sort(codes << 32 | places) & 0xFFFFFFFF
        offsets = np.concatenate([[0], np.cumsum(np.bincount(codes, minlength=len(order)))])
        return pa.RecordBatch.from_arrays(
            [
                pa.array([number], pa.int64()),
                pa.array([self.keys], pa.list_(pa.int64())),
                pa.array([counts.astype(np.int32)], pa.list_(pa.int32())),
                pa.array([bases.astype("<u4").tobytes()], pa.binary()),
                pa.ListArray.from_arrays(pa.array([0, len(order)], pa.int32()), found.dictionary.take(order)),
                pa.array([offsets.astype("<u4").tobytes()], pa.binary()),
                pa.array([np.diff(postings, prepend=0).astype("<u4").tobytes()], pa.binary()),
            ],
            names=["segment", "key", "n_words", "bases", "terms", "offsets", "postings"],
        )


def build_index(docs: DataFrame, key: str, text: str = "text", gap: int = GAP, segment_bytes: int = SEGMENT_BYTES) -> DataFrame:
    """The segments of ``docs``; ``key`` is a bigint column.  Each is complete for its documents.  Write it before it is searched."""

    def build(batches):
        from pyspark import TaskContext

        number = TaskContext.get().partitionId() << 32
        held = _Segment()
        for batch in slices(batches):
            for k, t in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                held.add(k, t.as_py())
                if held.bytes >= segment_bytes:
                    yield held.batch(number, gap)
                    number, held = number + 1, _Segment()
        if held.keys:
            yield held.batch(number, gap)
        del held
        tidy()

    return docs.select(F.col(key).cast("long"), F.col(text).cast("string")).mapInArrow(build, _SEGMENT)


class Block:
    """A block of items as arrays: their words one after the other, the windows, and each window's anchor."""

    def __init__(self, items: list[tuple[object, str | None]], size: int = WINDOW):
        numbers = _Numbers()
        bodies = [np.fromiter(map(numbers.__getitem__, w), np.int64, len(w)) for w in (words(t) for _, t in items)]
        sizes = np.array([len(b) for b in bodies], np.int64)
        self.vocabulary = pa.array(list(numbers), pa.binary())
        self.items = [str(i) for i, _ in items]
        self.words = np.concatenate(bodies) if bodies else np.empty(0, np.int64)
        ends = np.cumsum(sizes)
        #: Of each word: its item, and where that starts and ends.
        self.item = np.repeat(np.arange(len(sizes)), sizes)
        self.lo, self.hi = np.repeat(ends - sizes, sizes), np.repeat(ends, sizes)
        #: Each window's length, by its first word; 0 where none starts.
        at = np.arange(len(self.words))
        whole = np.minimum(self.hi - self.lo, size)
        self.length = np.where(at + whole <= self.hi, whole, 0)
        self.size = size

    def anchor(self, counts: np.ndarray) -> None:
        """Choose anchors by the ``counts`` of the vocabulary in the whole index.

        Keeps, for each anchor, the first and last window that it is the anchor of, and their length.
        """
        rarity = counts[self.words]
        starts, anchors = [], []
        for n in np.unique(self.length[self.length > 0]).tolist():
            first = np.flatnonzero(self.length == n)
            view = np.lib.stride_tricks.sliding_window_view(rarity, n)
            for lo in range(0, len(first), 1 << 17):
                some = first[lo : lo + (1 << 17)]
                best = view[some].argmin(axis=1)
                # A window with a term that no document has matches nothing.
                held = rarity[some + best] > 0
                starts.append(some[held])
                anchors.append((some + best)[held])
        first = np.concatenate(starts) if starts else np.empty(0, np.int64)
        at = np.concatenate(anchors) if anchors else np.empty(0, np.int64)
        order = np.lexsort((first, at))
        first, at = first[order], at[order]
        new = np.flatnonzero(np.append(True, at[1:] != at[:-1])) if len(at) else np.empty(0, np.int64)
        self.at = at[new]
        self.first = first[new]
        self.last = first[np.append(new[1:], len(at)) - 1] if len(at) else first
        self.n = self.length[self.first]


def _numbers_of(terms: pa.Array, vocabulary: pa.Array) -> np.ndarray:
    """The number in the vocabulary of each term, -1 if it is not there; no term becomes a Python object."""
    return pc.index_in(terms, value_set=vocabulary.cast(terms.type)).fill_null(-1).to_numpy().astype(np.int64)


class Reader:
    """A segment (row ``i`` of a batch) laid out for a block: the block's number of the word at each place (-1: none of its words)."""

    def __init__(self, batch: pa.RecordBatch, i: int, vocabulary: pa.Array):
        row = {name: batch.column(name)[i] for name in batch.schema.names}
        self.segment = row["segment"].as_py()
        self.bases = np.frombuffer(row["bases"].as_py(), "<u4").astype(np.int64)
        counts = row["n_words"].values.to_numpy().astype(np.int64)
        offsets = np.frombuffer(row["offsets"].as_py(), "<u4").astype(np.int64)
        places = np.cumsum(np.frombuffer(row["postings"].as_py(), "<u4"), dtype=np.uint32).astype(np.int64)
        own = _numbers_of(row["terms"].values, vocabulary)
        held = np.flatnonzero(own >= 0)
        self.from_ = np.zeros(len(vocabulary), np.int64)
        self.count = np.zeros(len(vocabulary), np.int64)
        self.from_[own[held]] = offsets[held]
        self.count[own[held]] = offsets[held + 1] - offsets[held]
        self.places = places
        # GAP empty places before the first document and after the last.
        end = int(self.bases[-1] + counts[-1]) if len(counts) else 0
        self.word = np.full(end + 2 * GAP, -1, np.int32)
        which = np.repeat(own, np.diff(offsets))
        some = which >= 0
        self.word[places[some] + GAP] = which[some]

    def documents(self, places: np.ndarray) -> np.ndarray:
        """The number, in the segment, of the document at each place."""
        return np.clip(np.searchsorted(self.bases, places, side="right") - 1, 0, max(0, len(self.bases) - 1))

    def candidates(self, block: Block):
        """Slices of (anchor's number, posting) over all anchors that the segment has."""
        n = self.count[block.words[block.at]]
        held = np.flatnonzero(n > 0)
        n = n[held]
        cuts = np.concatenate([[0], np.cumsum(n)])
        lo = 0
        while lo < len(held):
            hi = max(lo + 1, int(np.searchsorted(cuts, cuts[lo] + CANDIDATES, side="right")) - 1)
            many, first = n[lo:hi], self.from_[block.words[block.at[held[lo:hi]]]]
            which = np.repeat(held[lo:hi], many)
            index = np.arange(int(many.sum())) + np.repeat(first - (np.cumsum(many) - many), many)
            yield which, self.places[index]
            lo = hi

    def reach(self, block: Block, which: np.ndarray, place: np.ndarray, step: int, slop: int) -> np.ndarray:
        """How many terms beside each candidate's anchor follow in their places (within ``slop``), to one side."""
        at = block.at[which]
        out = np.zeros(len(which), np.int64)
        left = np.arange(len(which))
        most = int(block.n[which].max(initial=1)) - 1
        for k in range(1, most + 1):
            j = at[left] + step * k
            inside = (j >= block.lo[at[left]]) & (j < block.hi[at[left]])
            left, j = left[inside], j[inside]
            want = block.words[j]
            where = place[left] + step * k + GAP
            ok = self.word[where] == want
            for s in range(1, slop + 1):
                ok |= self.word[where + s] == want
                ok |= self.word[where - s] == want
            left = left[ok]
            if not len(left):
                break
            out[left] = k
        return out

    def matches(self, block: Block, slop: int = SLOP):
        """Exact hits (first and last place, item) and proximity matches (place, item) of the segment."""
        exact, near = [], []
        for which, place in self.candidates(block):
            n, at = block.n[which], block.at[which]
            back, on = self.reach(block, which, place, -1, slop), self.reach(block, which, place, 1, slop)
            # Some window with this anchor lies within what was reached.
            some = np.maximum(block.first[which], at - back) <= np.minimum(block.last[which], at + on - n + 1)
            near.append((place[some], block.item[at[some]]))
            # Whatever is exact is near, so only these are tried.
            which, place, n, at = which[some], place[some], n[some], at[some]
            back, on = self.reach(block, which, place, -1, 0), self.reach(block, which, place, 1, 0)
            some = back + on + 1 >= n
            exact.append((place[some] - back[some], place[some] + on[some] + 1, block.item[at[some]]))
        cat = lambda rows, i: np.concatenate([r[i] for r in rows]) if rows else np.empty(0, np.int64)
        return tuple(cat(exact, i) for i in range(3)), tuple(cat(near, i) for i in range(2))


def term_counts(index: DataFrame, vocabulary: pa.Array) -> np.ndarray:
    """How often each term of a block's vocabulary occurs in the whole index (only terms and offsets are read)."""

    def count(batches):
        total = np.zeros(len(vocabulary), np.int64)
        for batch in batches:
            for terms, offsets in zip(batch.column(0), batch.column(1), strict=True):
                own = _numbers_of(terms.values, vocabulary)
                n = np.diff(np.frombuffer(offsets.as_py(), "<u4").astype(np.int64))
                total[own[own >= 0]] += n[own >= 0]
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], names=["term", "n"])

    rows = index.select("terms", "offsets").mapInArrow(count, "term bigint, n bigint").groupBy("term").agg(F.sum("n").alias("n"))
    out = np.zeros(len(vocabulary), np.int64)
    with small_batches(index.sparkSession, wide=True):
        found = rows.collect()  # a number for each term of the block at most
    for r in found:
        out[r["term"]] = r["n"]
    return out


_FOUND = "segment bigint, doc int, starts array<bigint>, ends array<bigint>, items array<string>, near array<string>"


def search(index: DataFrame, items: list[tuple[object, str | None]], size: int = WINDOW, slop: int = SLOP) -> DataFrame:
    """One row for each document of a written index with a match: segment, its number there, hit runs, items, items nearby."""
    block = Block(items, size)
    block.anchor(term_counts(index, block.vocabulary))

    def run(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                seg = Reader(batch, i, block.vocabulary)
                (lo, hi, item), (place, near) = seg.matches(block, slop)
                out: dict[int, tuple[list, list, set, set]] = {}
                for d, x in set(zip(seg.documents(place).tolist(), near.tolist(), strict=True)):
                    out.setdefault(d, ([], [], set(), set()))[3].add(block.items[x])
                for d, x in set(zip(seg.documents(lo).tolist(), item.tolist(), strict=True)):
                    out[d][2].add(block.items[x])
                if len(lo):
                    lo, hi = _merge(lo, hi)
                    for d, a, b in zip(seg.documents(lo).tolist(), lo.tolist(), hi.tolist(), strict=True):
                        out[d][0].append(a - int(seg.bases[d]))
                        out[d][1].append(b - int(seg.bases[d]))
                rows = sorted(out.items())
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([seg.segment] * len(rows), pa.int64()),
                        pa.array([d for d, _ in rows], pa.int32()),
                        *(pa.array([r[k] for _, r in rows], pa.list_(pa.int64())) for k in (0, 1)),
                        *(pa.array([sorted(r[k]) for _, r in rows], pa.list_(pa.string())) for k in (2, 3)),
                    ],
                    names=["segment", "doc", "starts", "ends", "items", "near"],
                )
                del seg
        tidy()

    return index.mapInArrow(run, _FOUND)


def _merge(lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The union of the runs [lo, hi)."""
    order = np.argsort(lo, kind="stable")
    lo, hi = lo[order], np.maximum.accumulate(hi[order])
    first = np.append(True, lo[1:] > hi[:-1])
    last = np.append(first[1:], True)
    return lo[first], hi[last]


def _blocks(benchmark: DataFrame, item: str, text: str, block_bytes: int):
    """The benchmark in blocks of at most about ``block_bytes``, streamed to the driver and held one at a time."""
    block, size = [], 0
    rows = benchmark.where(F.col(item).isNotNull()).select(item, text).toLocalIterator()
    for row in rows:
        block.append((row[0], row[1]))
        size += 8 + len((row[1] or "").encode("utf-8", "surrogatepass"))
        if size >= block_bytes:
            yield block
            block, size = [], 0
    if block:
        yield block


def judge(
    docs: DataFrame,
    benchmark: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    item: str = "item_id",
    item_text: str = "text",
    block_bytes: int | None = None,
    slop: int = SLOP,
) -> DataFrame:
    """One row for each row of ``docs``: key, n_words, n_hit, items and near (strings, sorted), contaminated."""
    index = written(build_index(docs, key, text), "decontam-index", wide="written")
    found = docs.sparkSession.createDataFrame([], _FOUND)
    for block in _blocks(benchmark, item, item_text, block_bytes or BLOCK_BYTES):
        # Written, so that the driver and the tasks hold one block at a time.
        found = found.unionByName(written(search(index, block, slop=slop), "decontam-hits", wide="read"))
    merged = found.groupBy("segment", "doc").agg(
        F.array_sort(F.flatten(F.collect_list(F.arrays_zip("starts", "ends")))).alias("runs"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("near")))).alias("near"),
    )
    every = index.select("segment", F.posexplode(F.arrays_zip("key", "n_words")).alias("doc", "own"))
    every = every.select("segment", "doc", F.col("own.key").alias("key"), F.col("own.n_words").cast("long").alias("n_words"))
    # Runs of one document may overlap between blocks.
    n_hit = F.aggregate(
        "runs",
        F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("to")),
        lambda a, r: F.struct(
            (a["n"] + F.greatest(F.lit(0).cast("long"), r["ends"] - F.greatest(r["starts"], a["to"]))).alias("n"),
            F.greatest(a["to"], r["ends"]).alias("to"),
        ),
    )["n"]
    none = F.array().cast("array<string>")
    out = every.join(merged, ["segment", "doc"], "left").select(
        "key", "n_words", F.coalesce(n_hit, F.lit(0).cast("long")).alias("n_hit"), F.coalesce("items", none).alias("items"), F.coalesce("near", none).alias("near")
    )
    return out.withColumn("contaminated", (F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words")))


def digest(items: list[str]) -> str:
    """The digest of a sorted list of items, as the query gives it."""
    return hashlib.sha256(",".join(items).encode()).hexdigest()


def decontaminate(docs: DataFrame, benchmark: DataFrame, text: str = "text", item: str = "item_id", item_text: str = "text") -> DataFrame:
    """``docs`` without the contaminated rows; every row is judged by its own text, whatever its id.

    Rows with a null or empty text stay; repeated rows stay or go together; all
    columns are kept; an empty table or benchmark takes nothing away.
    """
    row = "_row"
    while row in docs.columns:
        row += "_"
    numbered = written(docs.withColumn(row, F.monotonically_increasing_id()), "decontam-docs")
    judged = judge(numbered, benchmark, row, text, item, item_text)
    gone = judged.where("contaminated").select(F.col("key").alias(row))
    return numbered.join(gone, row, "left_anti").select(*docs.columns)
