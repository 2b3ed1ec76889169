"""Token-id files compressed by Re-Pair, with random access.

A file holds the ids of consecutive documents.  Re-Pair replaces the most
frequent pair of neighbouring symbols by a new symbol (nonterminal) and goes on
with what is left until no pair occurs ``LEAST`` times (two: none repeats).

Pairs go in batches whose counts are exact.  A level holds the pairs that occur
``level`` times or more; of these a batch takes, the most frequent first, pairs
in which no symbol is a left one here and a right one there.  Their occurrences
cannot overlap, so replacing them at once is the same as one after the other,
and each rule stands for exactly the count it was chosen by (a pair of one
symbol counts and is replaced from the left, every other one of a run).  Counts
are taken anew for each batch; a level ends when no pair reaches it, and the
next is a ``RATIO``-th of it.

Format (little-endian)::

    magic b"LRP2", n_terminals u4, n_rules u4, n_symbols u4, n_docs u4, n_ids u8
    rules        2 x n_rules symbols: left and right of each
    lengths      n_rules x u4    ids each rule expands to
    symbols      n_symbols symbols: below n_terminals an id; else rule n_terminals + k
    marks        u8 for every STEP symbols: ids before it
    docs         n_docs x u8     ids before each document

Symbols have 24 bits, in two planes: the low 16 bits of all as u2, then the high
8 bits of all as u1.  A rule refers to earlier ones only.  Ids of 2^23 or more
are refused.  A document's ids start at a known id; the marks give the symbol
block that it begins in, and the expansion lengths lead to the symbol, so one
document is decoded without the others.

The files are rows of a table (first document, file, payload), written by
Spark's committer in the shared folder, so that a lost executor costs only its
tasks.  Documents are range-partitioned by id; a file ends after ``FILE_IDS``
ids, so memory is bounded whatever a partition holds.

Defined results: a null or empty text has the end id alone; equal ids go by
text; null ids come first; a text of any length is encoded whole and lies in one
file; other columns, whatever their names, are not carried; an empty table gives
no file and no row.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import tokens
from .common import prefix_sums, written

MAGIC = b"LRP2"
TERMINALS = 49_408
END_ID = 1
LEAST = 2
RATIO = 64
STEP = 256
FILE_IDS = 1 << 17
PARTITION_BYTES = 24 << 20
#: Pairs of a batch's first slice.
SETTLED = 512

_HIGH = 32
_LOW = (1 << _HIGH) - 1


def _alternate(at: np.ndarray, twice: np.ndarray) -> np.ndarray:
    """Which rows of ``at`` go when of neighbouring places among those flagged in ``twice`` every other one goes, from the left."""
    flagged = np.flatnonzero(twice)
    p = at[flagged]
    joined = p[1:] == p[:-1] + 1
    if not joined.any():
        return flagged[:0]
    starts = np.flatnonzero(np.append(True, ~joined))
    run = np.repeat(starts, np.diff(np.append(starts, len(p))))
    return flagged[(np.arange(len(p)) - run) & 1 == 1]


def _batch(left: np.ndarray, right: np.ndarray, symbols: int) -> np.ndarray:
    """Of the pairs in order those that fit together: no symbol is a left one of some and a right one of others.

    Pairs go in growing slices; those that earlier slices have settled are not looked at one by one.
    """
    side = bytearray(symbols)  # 1 left, 2 right, 3 both (its own pair)
    sides = np.frombuffer(side, np.uint8)
    taken = []
    lo, step = 0, SETTLED
    while lo < len(left):
        a, b = left[lo : lo + step], right[lo : lo + step]
        state = np.take(sides, a) << 2 | np.take(sides, b)
        # Left there and right here (6): taken. An odd state, or one above, has a symbol on its other side.
        taken.append(np.flatnonzero(state == 6) + lo)
        new = np.flatnonzero((state < 6) & (state & 1 == 0))
        taken.append(new[_first_fit(np.take(a, new).tolist(), np.take(b, new).tolist(), side)] + lo)
        lo, step = lo + step, 2 * step
    return np.sort(np.concatenate(taken)) if taken else np.empty(0, np.int64)


def _first_fit(left: list[int], right: list[int], side: bytearray) -> np.ndarray:
    """Of the pairs in order those that fit ``side``, which they change."""
    taken = []
    take = taken.append
    i = 0
    for a, b in zip(left, right, strict=True):
        x = side[a]
        if x < 2:
            if a == b:
                if not x:
                    side[a] = 3
                    take(i)
            else:
                y = side[b]
                if y == 2:
                    side[a] = 1
                    take(i)
                elif not y:
                    side[a], side[b] = 1, 2
                    take(i)
        i += 1
    return np.array(taken, np.int64)


def _grouped(left: np.ndarray, right: np.ndarray, at: np.ndarray, symbols: int, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The places ``at`` by pair (left, then right, then place), each pair's first row there, and its count."""
    wide, places = symbols.bit_length(), length.bit_length()
    pair = left.astype(np.int64)
    pair <<= wide
    pair |= right
    if 2 * wide + places < 64:
        # A pair and its place are one number.
        pair <<= places
        pair |= at
        pair.sort()
        at = pair & ((1 << places) - 1)
        pair >>= places
    else:
        order = np.argsort(pair, kind="stable")
        at, pair = at[order], pair[order]
    new = np.ones(len(pair), bool)
    np.not_equal(pair[1:], pair[:-1], out=new[1:])
    first = np.flatnonzero(new)
    return at, first, np.diff(first, append=len(pair))


def grammar(ids: np.ndarray, terminals: int, least: int = LEAST, ratio: int = RATIO) -> tuple[np.ndarray, np.ndarray]:
    """What Re-Pair leaves of ``ids``, and the rules' pairs (left << 32 | right); rule k is the symbol ``terminals + k``."""
    s = ids.astype(np.int32 if terminals + len(ids) < 1 << 31 else np.int64)
    n = terminals
    # How often each symbol stands there: a pair is no more frequent than either.
    often = np.zeros(terminals + len(s), np.int64)
    often[:terminals] = np.bincount(s, minlength=terminals)
    level = max(least, int(often.max(initial=0)) // ratio)
    rules: list[np.ndarray] = []
    # What was too rare at this level stays so: after a batch only pairs with a new symbol and
    # pairs that did not fit into the batch are counted again.
    fresh, rest = None, None
    while len(s) > 1:
        mark = (often[:n] >= level).view(np.uint8)
        if fresh is not None:
            mark[fresh:] |= 2
            mark[rest[0]] |= 4
            mark[rest[1]] |= 8
        f = np.take(mark, s)
        x, y = f[:-1], f[1:]
        held = x & y & 1
        if fresh is not None:
            held &= (x | y) >> 1 | x >> 2 & y >> 3
        at = np.flatnonzero(held.view(bool))
        left, right = np.take(s, at), np.take(s[1:], at)
        over = _alternate(at, left == right)
        if len(over):
            at, left, right = np.delete(at, over), np.delete(left, over), np.delete(right, over)
        at, first, count = _grouped(left, right, at, n, len(s))
        top = np.flatnonzero(count >= level)
        if not len(top):
            if level == least:
                break
            level, fresh = max(least, level // ratio), None
            continue
        top = top[_falling(count[top])]
        first, count = first[top], count[top]
        left, right = np.take(s, at[first]).astype(np.int64), np.take(s[1:], at[first]).astype(np.int64)
        taken = _batch(left, right, n)
        other = np.ones(len(top), bool)
        other[taken] = False
        fresh, rest = n, (left[other], right[other])
        left, right, first, count = left[taken], right[taken], first[taken], count[taken]
        s = _replace(s, at, first, count, n)
        np.subtract.at(often, left, count)
        np.subtract.at(often, right, count)
        often[n : n + len(taken)] = count
        n += len(taken)
        rules.append(left << _HIGH | right)
    return s, np.concatenate(rules) if rules else np.empty(0, np.int64)


def _falling(count: np.ndarray) -> np.ndarray:
    """The order of falling counts, equal ones as they come; short numbers are sorted by their digits."""
    most = int(count.max(initial=0))
    return np.argsort((most - count).astype(np.uint16) if most < 1 << 16 else -count, kind="stable")


def _replace(s: np.ndarray, at: np.ndarray, first: np.ndarray, count: np.ndarray, symbol: int) -> np.ndarray:
    """``s`` (changed) with pair k, at the ``count[k]`` places in ``at`` from ``first[k]`` on, replaced by ``symbol + k``."""
    ends = np.cumsum(count)
    rows = np.repeat(first - (ends - count), count)
    rows += np.arange(len(rows))
    places = np.take(at, rows)
    s[places] = np.repeat(np.arange(symbol, symbol + len(count), dtype=s.dtype), count)
    keep = np.ones(len(s), bool)
    keep[places + 1] = False
    return s[keep]


def _planes(symbols: np.ndarray) -> bytes:
    return (symbols & 0xFFFF).astype("<u2").tobytes() + (symbols >> 16).astype("u1").tobytes()


def compress(ids: np.ndarray, starts: np.ndarray, terminals: int = TERMINALS, least: int = LEAST) -> bytes:
    """A file of ``ids`` (below ``terminals``); ``starts`` are the documents' first ids."""
    if len(ids) and int(ids.max()) >= terminals or terminals + len(ids) > 1 << 24:
        raise ValueError(f"ids must be below {terminals}, and these with as many rules below {1 << 24}")
    s, pairs = grammar(ids, terminals, least)
    rules = np.stack([pairs >> _HIGH, pairs & _LOW], 1)
    lengths = _lengths(rules, terminals)
    sizes = np.ones(len(s), np.int64)
    big = s >= terminals
    sizes[big] = lengths[s[big] - terminals]
    ends = np.cumsum(sizes)
    marks = np.concatenate([[0], ends])[: len(s) : STEP] if len(s) else np.empty(0, np.int64)
    return b"".join(
        [
            MAGIC,
            struct.pack("<IIIIQ", terminals, len(pairs), len(s), len(starts), len(ids)),
            _planes(rules.ravel()),
            lengths.astype("<u4").tobytes(),
            _planes(s),
            marks.astype("<u8").tobytes(),
            np.asarray(starts).astype("<u8").tobytes(),
        ]
    )


def _runs(rules: np.ndarray, terminals: int):
    """Runs lo, hi of rules that refer to rules before ``lo`` only."""
    last = rules.max(axis=1) - terminals if len(rules) else np.empty(0, np.int64)
    lo = 0
    while lo < len(rules):
        inside = last[lo:] >= lo
        hi = lo + int(inside.argmax()) if inside.any() else len(rules)
        yield lo, hi
        lo = hi


def _lengths(rules: np.ndarray, terminals: int) -> np.ndarray:
    """How many ids each rule expands to."""
    out = np.ones(len(rules), np.int64)
    for lo, hi in _runs(rules, terminals):
        part = rules[lo:hi]
        out[lo:hi] = np.where(part >= terminals, out[np.maximum(part - terminals, 0)], 1).sum(axis=1)
    return out


class File:
    """Reads a compressed file."""

    def __init__(self, data: bytes):
        if data[:4] != MAGIC:
            raise ValueError("not a file of this format")
        self.terminals, rules, symbols, docs, self.n_ids = struct.unpack_from("<IIIIQ", data, 4)
        at = 4 + struct.calcsize("<IIIIQ")

        def take(kind: str, n: int) -> np.ndarray:
            nonlocal at
            out = np.frombuffer(data, kind, n, at)
            at += out.nbytes
            return out

        def symbols_of(n: int) -> np.ndarray:
            low = take("<u2", n).astype(np.int64)
            return low | take("u1", n).astype(np.int64) << 16

        self.rules = symbols_of(2 * rules).reshape(-1, 2)
        self.lengths = take("<u4", rules).astype(np.int64)
        self.symbols = symbols_of(symbols)
        self.marks = take("<u8", -(-symbols // STEP))
        self.starts = take("<u8", docs).astype(np.int64)

        # Every symbol's ids, one after the other: a symbol expands to a slice.
        self.size = np.concatenate([np.ones(self.terminals, np.int64), self.lengths])
        ends = np.cumsum(self.size)
        self.first = ends - self.size
        self.flat = np.empty(int(ends[-1]) if len(ends) else 0, "<u4")
        self.flat[: self.terminals] = np.arange(self.terminals)
        for lo, hi in _runs(self.rules, self.terminals):
            lo_at = int(self.first[self.terminals + lo])
            made = self.expand(self.rules[lo:hi].ravel())
            self.flat[lo_at : lo_at + len(made)] = made

    def expand(self, s: np.ndarray) -> np.ndarray:
        """The ids of symbols."""
        sizes = self.size[s]
        ends = np.cumsum(sizes)
        if not len(ends):
            return np.empty(0, "<u4")
        at = np.repeat(self.first[s] - (ends - sizes), sizes)
        at += np.arange(ends[-1])
        return self.flat[at]

    def all(self) -> np.ndarray:
        """All ids of the file."""
        return self.expand(self.symbols)

    def ids(self, lo: int, hi: int) -> np.ndarray:
        """Ids lo..hi of the file, decoding only the blocks of symbols that hold them."""
        if hi <= lo:
            return np.empty(0, "<u4")
        block = int(np.searchsorted(self.marks, lo, side="right")) - 1
        last = int(np.searchsorted(self.marks, hi, side="left"))
        s = self.symbols[block * STEP : last * STEP]
        sizes = self.size[s]
        ends = np.cumsum(sizes) + int(self.marks[block])
        a = int(np.searchsorted(ends, lo, side="right"))
        b = int(np.searchsorted(ends, hi, side="left")) + 1
        first = int(ends[a] - sizes[a])
        return self.expand(s[a:b])[lo - first : hi - first]

    def document(self, k: int) -> np.ndarray:
        """The ids of the file's document ``k``."""
        hi = int(self.starts[k + 1]) if k + 1 < len(self.starts) else int(self.n_ids)
        return self.ids(int(self.starts[k]), hi)


def write_files(docs: DataFrame, key: str = "doc_id", text: str = "text", path: str | None = None, end_id: int = END_ID) -> DataFrame:
    """The files of ``docs``: part, file, n_ids, keys, payload, ordered by (part, file)."""
    path = path or tokens.default_path("word_bpe_49k.json")
    kind = docs.schema[key].dataType.simpleString()
    rows = docs.select(F.col(key).alias("key"), F.col(text).cast("string").alias("text"))
    size = rows.agg(F.sum(F.coalesce(F.octet_length("text"), F.lit(0)) + 16)).first()[0] or 0
    parts = max(1, -(-int(size) // PARTITION_BYTES))
    ordered = rows.repartitionByRange(parts, F.col("key").asc_nulls_first(), F.xxhash64("text")).sortWithinPartitions(
        F.col("key").asc_nulls_first(), F.xxhash64("text"), "text"
    )

    def make(batches):
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        encode = tokens.encoder(path, False)
        end = int(end_id).to_bytes(4, "little")
        held, keys, size, file = [], [], 0, 0

        def flush():
            sizes = np.array([len(h) // 4 for h in held], np.int64)
            ids = np.frombuffer(b"".join(held), "<u4")
            data = compress(ids, np.concatenate([[0], np.cumsum(sizes)[:-1]]))
            return pa.RecordBatch.from_arrays(
                [pa.array([part], pa.int32()), pa.array([file], pa.int32()), pa.array([len(ids)], pa.int64()), pa.array([keys], pa.list_(key_type)), pa.array([data], pa.binary())],
                names=["part", "file", "n_ids", "keys", "payload"],
            )

        for batch in batches:
            key_type = batch.schema.field(0).type
            for lo in range(0, batch.num_rows, 2000):
                some = batch.slice(lo, 2000)
                texts = [t or "" for t in some.column(1).to_pylist()]
                for k, ids in zip(some.column(0).to_pylist(), encode.encode_many(texts), strict=True):
                    held.append(ids + end)
                    keys.append(k)
                    size += len(held[-1]) // 4
                    if size >= FILE_IDS:
                        yield flush()
                        held, keys, size, file = [], [], 0, file + 1
        if held:
            yield flush()

    return written(ordered.mapInArrow(make, f"part int, file int, n_ids bigint, keys array<{kind}>, payload binary"), "ids", wide="written")


def read_files(files: DataFrame, key: str = "doc_id") -> DataFrame:
    """One row for each document of the files: key, start, n_tokens, ids_crc32."""
    kind = files.schema["keys"].dataType.elementType.simpleString()
    spark = files.sparkSession
    totals = files.select("part", "file", "n_ids")
    sums = totals.groupBy("part").agg(F.sum("n_ids").alias("n"))
    last = sums.agg(F.max("part")).first()[0]
    dense = spark.range((last if last is not None else -1) + 1).select(F.col("id").cast("int").alias("part")).join(sums, "part", "left")
    before = prefix_sums(dense.select("part", F.coalesce("n", F.lit(0)).alias("n")), "part", "n").select("part", F.col("before").alias("_part"))
    from pyspark.sql import Window

    within = Window.partitionBy("part").orderBy("file").rowsBetween(Window.unboundedPreceding, -1)
    firsts = totals.withColumn("_file", F.coalesce(F.sum("n_ids").over(within), F.lit(0))).join(before, "part")
    firsts = firsts.select("part", "file", (F.col("_file") + F.col("_part")).cast("long").alias("first"))

    def read(batches):
        for batch in batches:
            for row in range(batch.num_rows):
                file = File(batch.column(3)[row].as_py())
                ids = file.all()
                starts = file.starts
                ends = np.append(starts[1:], file.n_ids)
                crc = [zlib.crc32(ids[a:b].tobytes()) for a, b in zip(starts.tolist(), ends.tolist(), strict=True)]
                n = len(starts)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(2)[row].values,
                        pa.array(np.full(n, batch.column(0)[row].as_py(), np.int32)),
                        pa.array(np.full(n, batch.column(1)[row].as_py(), np.int32)),
                        pa.array(starts.astype(np.int64)),
                        pa.array((ends - starts).astype(np.int64)),
                        pa.array(crc, pa.int64()),
                    ],
                    names=[key, "part", "file", "_at", "n_tokens", "ids_crc32"],
                )

    decoded = files.select("part", "file", "keys", "payload").mapInArrow(
        read, f"`{key}` {kind}, part int, file int, _at bigint, n_tokens bigint, ids_crc32 bigint"
    )
    return decoded.join(firsts, ["part", "file"]).select(key, (F.col("first") + F.col("_at")).alias("start"), "n_tokens", "ids_crc32")
