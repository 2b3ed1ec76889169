"""MinHash near-duplicates: banding, exact verification, components.

1. Each text becomes its set of word shingles (64-bit hashes) and ``BANDS`` x
   ``ROWS`` minima under multiply-shift hashes.  Rows with the same set share a
   class (its smallest id stands for it), so a group of copies is one node.
2. Classes with an equal band are candidates.  At similarity 0.8 a pair shares
   no band of 32 bands of 4 rows with probability (1 - 0.8^4)^32 = 5e-8.
3. In each bucket the smallest class is compared with the others; links are
   confirmed on the full sets.  A leader's set goes once to each part of its
   members, whose sets stream by.  Components of these links settle most buckets.
4. What is left are buckets whose other members lie in different components.
   They are compared with each other in blocks of about ``BLOCK_ROWS``: one task takes
   two blocks, counts all intersections by a matrix product, and gives only
   the links that join different components (a forest, fewer than its rows).
5. Components by alternating large-star and small-star.

So every pair that shares a band is compared on full sets unless it is joined
already, no pairs of a group are listed, and no group has to fit in one task.

Defined results: a text without words (null, empty, white space) has no
shingle, is linked with nothing and is kept; a text of fewer words than a
shingle has one, the whole sequence; rows with one id are one document; rows
with a null id get a null component and are kept; texts of any length are taken
whole; ``keep_one`` carries other columns, whatever their names; an empty table
gives no row.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import mix64, skewed_join, slices, written
from .components import components

BANDS, ROWS = 32, 4
SHINGLE = 4
NUMERATOR, DENOMINATOR = 80, 100
BLOCK_ROWS, BLOCK_BYTES = 512, 4 << 20
MEMBERS = 2048

_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
_KEEP = 200_000


class _WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        h = xxhash.xxh3_64_intdigest(word)
        if len(self) < _KEEP:
            self[word] = h
        return h


_hashes = _WordHashes()


def _forget() -> None:
    """At a task's end: the process goes on to other work."""
    _hashes.clear()


def shingles(text: str | None, size: int = SHINGLE) -> np.ndarray:
    """The sorted distinct shingle hashes of a text."""
    words = (text or "").encode("utf-8", "surrogatepass").translate(_LOWER).split()
    n = len(words)
    if not n:
        return np.empty(0, np.uint64)
    w = np.fromiter(map(_hashes.__getitem__, words), np.uint64, n)
    k = min(size, n)
    h = w[: n - k + 1].copy()
    for i in range(1, k):
        h *= np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(29)
        h += w[i : n - k + 1 + i]
    h = np.sort(mix64(h + np.uint64(k)))
    return h[np.append(True, h[1:] != h[:-1])]


def _multipliers(n: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(20240229)
    a = rng.integers(0, 2**63, n, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    return a, rng.integers(0, 2**63, n, dtype=np.uint64)


_A, _B = _multipliers(BANDS * ROWS)


def minima(s: np.ndarray, a: np.ndarray = _A, b: np.ndarray = _B) -> np.ndarray:
    """The minimum of each universal hash (the high half of a*x + b) over a set."""
    out = np.full(len(a), 0xFFFFFFFF, np.uint32)
    for lo in range(0, len(s), 512):
        x = s[lo : lo + 512]
        h = (a[:, None] * x[None, :] + b[:, None]) >> np.uint64(32)
        np.minimum(out, h.min(axis=1).astype(np.uint32), out=out)
    return out


def band_keys(m: np.ndarray, bands: int = BANDS, rows: int = ROWS) -> np.ndarray:
    """One 64-bit key for each band; the band's number is mixed in."""
    h = np.arange(bands, dtype=np.uint64)
    for i in range(rows):
        h = mix64(h * np.uint64(0x9E3779B97F4A7C15) + m.reshape(bands, rows)[:, i].astype(np.uint64))
    return h.view(np.int64)


def signatures(docs: DataFrame, key: str, text: str, size: int = SHINGLE) -> DataFrame:
    """key, n_shingles, the set's fingerprint and its band keys, for each row."""
    kind = docs.schema[key].dataType.simpleString()

    def sign(batches):
        for part in slices(batches):
            n, prints, bands = [], [], []
            for text in part.column(1).to_pylist():
                s = shingles(text, size)
                n.append(len(s))
                prints.append(xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None)
                bands.append(band_keys(minima(s)) if len(s) else None)
            yield pa.RecordBatch.from_arrays(
                [part.column(0), pa.array(n, pa.int64()), pa.array(prints, pa.binary()), pa.array(bands, pa.list_(pa.int64()))],
                names=[key, "n_shingles", "print", "bands"],
            )
        _forget()

    return docs.select(F.col(key), F.col(text).cast("string")).mapInArrow(
        sign, f"`{key}` {kind}, n_shingles bigint, print binary, bands array<bigint>"
    )


def _sets(docs: DataFrame, wanted: DataFrame, key: str, text: str, size: int = SHINGLE) -> DataFrame:
    """The full sets (binary, sorted) of the documents in ``wanted`` (column node)."""

    def make(batches):
        for batch in slices(batches):
            sets = [shingles(t, size).tobytes() for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sets, pa.binary())], names=["node", "set"])
        _forget()

    rows = docs.select(F.col(key).cast("bigint").alias("node"), F.col(text).cast("string").alias("text")).join(wanted, "node", "left_semi")
    return rows.mapInArrow(make, "node bigint, set binary")


def alike(a: bytes, b: bytes) -> bool:
    """Whether 100 * intersection >= 80 * union, for two sorted sets."""
    x, y = np.frombuffer(a, np.uint64), np.frombuffer(b, np.uint64)
    if not len(x) or not len(y) or DENOMINATOR * min(len(x), len(y)) < NUMERATOR * max(len(x), len(y)):
        return False
    at = np.searchsorted(x, y)
    at[at == len(x)] = 0
    both = int(np.count_nonzero(x[at] == y))
    return DENOMINATOR * both >= NUMERATOR * (len(x) + len(y) - both)


def _verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (u, v) whose full sets are alike; ``pairs`` is a written table.

    A leader ``u`` of many members is split into parts of about ``MEMBERS``.  Its
    set goes once to each part, before the members' sets, and these stream by.
    """
    counts = written(pairs.groupBy("u").agg(F.count(F.lit(1)).alias("n")).withColumn("parts", F.ceil(F.col("n") / MEMBERS)), "leaders")
    dealt = skewed_join(pairs, counts, "u", "n").select("u", F.pmod(F.xxhash64("v"), "parts").alias("part"), "v")
    members = dealt.join(sets.select(F.col("node").alias("v"), "set"), "v").select("u", "part", "v", "set")
    leaders = counts.select("u", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("part"))
    leaders = leaders.join(sets.select(F.col("node").alias("u"), "set"), "u").select("u", "part", F.lit(None).cast("long").alias("v"), "set")
    rows = members.unionByName(leaders).repartition("u", "part").sortWithinPartitions("u", "part", F.col("v").asc_nulls_first())

    def check(batches):
        leader = None
        for batch in slices(batches, 64):
            us, vs = [], []
            for u, v, s in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), batch.column(3), strict=True):
                if v is None:
                    leader = s.as_py()
                elif alike(leader, s.as_py()):
                    us.append(u)
                    vs.append(v)
            yield pa.RecordBatch.from_arrays([pa.array(us, pa.int64()), pa.array(vs, pa.int64())], names=["u", "v"])

    return rows.mapInArrow(check, "u bigint, v bigint")


def forest(nodes: list[int], labels: list[int], sets: list[bytes], side: list[bool]) -> list[tuple[int, int]]:
    """Links between different labels that join them: a forest over the labels.

    Rows with ``side`` are compared with those without, or all with each other
    when there is one side only.
    """
    values = [np.frombuffer(s, np.uint64) for s in sets]
    sizes = np.array([len(v) for v in values])
    n = len(nodes)
    every, inverse = np.unique(np.concatenate(values) if n else np.empty(0, np.uint64), return_inverse=True)
    owner = np.repeat(np.arange(n), sizes)
    often = np.bincount(inverse, minlength=len(every)) > 1
    column = np.cumsum(often) - 1
    held = often[inverse]
    owner, column = owner[held], column[inverse[held]]
    width = int(np.count_nonzero(often))
    order = np.argsort(column, kind="stable")
    owner, column = owner[order], column[order]
    both = np.zeros((n, n), np.float32)
    for lo in range(0, width, 4096):
        a, b = np.searchsorted(column, [lo, lo + 4096])
        block = np.zeros((n, min(4096, width - lo)), np.float32)
        block[owner[a:b], column[a:b] - lo] = 1
        both += block @ block.T
    total = sizes[:, None] + sizes[None, :] - both
    links = (DENOMINATOR * both.astype(np.float64) >= NUMERATOR * total) & (sizes[:, None] > 0) & (sizes[None, :] > 0)
    marks = np.array(labels)
    links &= marks[:, None] != marks[None, :]
    s = np.array(side)
    if s.any() and not s.all():
        links &= s[:, None] != s[None, :]
    root: dict[int, int] = {}

    def find(x: int) -> int:
        while root.get(x, x) != x:
            root[x] = x = root.get(root[x], root[x])
        return x

    out = []
    for i in range(n):
        at = np.flatnonzero(links[i, i + 1 :]) + i + 1
        # One link to each label is enough.
        for label, k in zip(*np.unique(marks[at], return_index=True), strict=True):
            p, q = find(labels[i]), find(int(label))
            if p != q:
                root[max(p, q)] = min(p, q)
                out.append((nodes[i], nodes[int(at[k])]))
    return out


def _rest(buckets: DataFrame, labels: DataFrame, sets: DataFrame) -> DataFrame:
    """Links among the other members of buckets (key, node, n, leader) that lie in different components."""
    members = buckets.where("node != leader").join(labels, "node", "left").select("key", "node", "n", F.coalesce("component", "node").alias("label"))
    members = written(members, "members")
    mixed = members.groupBy("key").agg(
        F.min("label").alias("lo"), F.max("label").alias("hi"), F.count(F.lit(1)).alias("m"), F.sum("n").alias("all_n")
    ).where("lo != hi")
    blocks = F.greatest(F.ceil(F.col("m") / BLOCK_ROWS), F.ceil(8 * F.col("all_n") / BLOCK_BYTES)).cast("int")
    mixed = written(mixed.select("key", "m", blocks.alias("blocks")), "mixed")
    # A bucket of any size is dealt to blocks; its sets are fetched by document, not by bucket.
    rows = skewed_join(members.select("key", "node", "label"), mixed, "key", "m")
    rows = rows.withColumn("own", F.pmod(F.xxhash64(F.lit(1), "node"), F.col("blocks")).cast("int"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    rows = rows.join(sets.select("node", "set"), "node")
    rows = rows.select("key", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "node", "label", "set")

    def compare(batches_or_table: pa.Table) -> pa.Table:
        t = batches_or_table
        i = t.column("i")[0].as_py()
        links = forest(
            t.column("node").to_pylist(), t.column("label").to_pylist(), t.column("set").to_pylist(),
            [o == i for o in t.column("own").to_pylist()],
        )
        out = pa.table({"u": pa.array([a for a, _ in links], pa.int64()), "v": pa.array([b for _, b in links], pa.int64())})
        return out

    return rows.groupBy("key", "i", "j").applyInArrow(compare, "u bigint, v bigint")


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", size: int = SHINGLE) -> DataFrame:
    """key, n_shingles, component_id, kept for each row of ``docs``; ``key`` is an integer, ``size`` the words of a shingle."""
    signed = written(signatures(docs, key, text, size), "signatures")
    own = F.col(key).cast("bigint")
    has = signed.where(F.col("print").isNotNull() & F.col(key).isNotNull())
    # One row for each different set, its smallest id, and the bands that all copies share.
    classes = has.groupBy("print").agg(F.min(own).alias("node"), F.min_by("bands", own).alias("bands"), F.max("n_shingles").alias("n"), F.count(F.lit(1)).alias("m"))
    classes = written(classes, "classes")
    exploded = classes.select("node", "n", F.explode("bands").alias("key"))
    full = exploded.groupBy("key").agg(F.min(F.struct("node", "n")).alias("first"), F.max("node").alias("_last"), F.count(F.lit(1)).alias("m"))
    full = written(full.where("first.node != _last").select("key", F.col("first.node").alias("leader"), F.col("first.n").alias("leader_n"), "m"), "keys")
    buckets = written(skewed_join(exploded, full, "key", "m"), "buckets")
    # Sets whose sizes differ too much cannot be alike.
    close = F.lit(DENOMINATOR) * F.least("n", "leader_n") >= F.lit(NUMERATOR) * F.greatest("n", "leader_n")
    pairs = written(buckets.where(close & (F.col("node") != F.col("leader"))).select(F.col("leader").alias("u"), F.col("node").alias("v")).distinct(), "pairs")
    sets = written(_sets(docs, buckets.select("node").distinct(), key, text, size), "sets")
    links = written(_verified(pairs, sets), "links", few=True)
    labels = components(links)
    more = written(_rest(buckets, labels, sets), "links", few=True)
    copies = skewed_join(has.select(own.alias("u"), "print"), classes.select("print", "node", "m"), "print", "m").select("u", F.col("node").alias("v"))
    if not more.isEmpty():
        labels = components(labels.select(F.col("node").alias("u"), F.col("component").alias("v")).unionByName(more))
    # A copy reaches what its class reaches.  Rows with one id but different texts tie their classes.
    tied = copies.groupBy("u").agg(F.min("v").alias("a"), F.max("v").alias("b"))
    split = tied.where("a != b").select(F.col("u"), F.col("a").alias("v")).unionByName(
        copies.join(tied.where("a != b").select("u"), "u", "left_semi").select("u", "v")
    )
    if not split.isEmpty():
        labels = components(labels.select(F.col("node").alias("u"), F.col("component").alias("v")).unionByName(split))
    # A class without a link is its own component.
    homes = tied.groupBy("a").agg(F.count(F.lit(1)).alias("m")).join(labels.withColumnRenamed("node", "a"), "a", "left")
    homes = written(homes.select("a", "m", F.coalesce("component", "a").alias("component_id")), "places")
    place = skewed_join(tied.select(F.col("u").alias("_id"), "a"), homes, "a", "m").drop("a")
    out = signed.join(place, own == F.col("_id"), "left")
    component = F.coalesce(F.col("component_id"), own)
    return out.select(F.col(key), "n_shingles", component.alias("component_id"), F.coalesce(own == component, F.lit(True)).alias("kept"))


def keep_one(docs: DataFrame, key: str = "doc_id", text: str = "text", size: int = SHINGLE) -> DataFrame:
    """``docs`` without the documents that are near-duplicates of one with a smaller id.

    Rows with a null id or without words stay; rows with one id are one
    document and stay or go together; all columns are kept; an empty table gives
    an empty result.
    """
    gone = near_duplicates(docs, key, text, size).where("not kept").select(key).distinct()
    return docs.join(gone, key, "left_anti").select(*docs.columns)
