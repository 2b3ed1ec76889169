"""Document fingerprints by content-defined chunking.

A gear hash rolls over a text's UTF-8 bytes: h(i) = 2 h(i-1) + G[byte], so it
depends on the last 32 bytes only.  A chunk ends where the hash's high bits are
zero; chunking is normalised: before the usual size more bits are asked for,
after it fewer, and a chunk has a least and a most size.  An insertion moves the
boundaries with it, so only the chunks that it touches change.  Sizes and masks
are the same at every depth, so a passage is cut alike wherever it lies; they
are small so that short texts have several chunks.

The edited text's fingerprint is kept as what the own one lost and got, and both
are written out at the end.

A fingerprint is the set of chunks, each as ``DIGITS`` hex digits of its digest
and two of its length, sorted, in one string.  Likeness is the containment of
the smaller set in the other, weighted by length: shared bytes over its bytes.

For the hash of all positions of many texts at once the recurrence is unrolled
by doubling: the hash over 2w bytes is the hash over w bytes plus the one w
bytes earlier, shifted by w.

The next document (ascending id, ties by text) is found by range-partitioning
on the id and sorting: only the first and last document of each partition
cross to another task.

Defined results: a null or empty text has no chunk and an empty fingerprint;
two empty fingerprints are alike by 1, an empty and another by 0; null ids come
first; one row alone is its own next document; texts of any length are chunked
whole; other columns, whatever their names, are not carried; an empty table
gives no row.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import slices, written

#: Least, usual and most bytes of a chunk; bits asked for before and after the usual size.
LEAST, USUAL, MOST = 8, 32, 128
STRICT_BITS, LOOSE_BITS = 6, 3
DIGITS = 8
PARTITION_BYTES = 24 << 20

def gear_table(seed: int = 9) -> np.ndarray:
    return np.random.default_rng(seed).integers(0, 2**32, 256, dtype=np.uint32)


_GEAR = gear_table()


def gear_hashes(data: bytes) -> np.ndarray:
    """The gear hash at each byte."""
    h = _GEAR[np.frombuffer(data, np.uint8)]
    w = 1
    while w < 32 and w < len(h):
        out = h.copy()
        out[w:] += h[:-w] << np.uint32(w)
        h, w = out, 2 * w
    return h


def boundaries(data: bytes) -> list[int]:
    """Where each chunk ends."""
    n = len(data)
    h = gear_hashes(data)
    out, at = [], 0
    strict = (np.flatnonzero(h >> np.uint32(32 - STRICT_BITS) == 0) + 1).tolist()
    loose = (np.flatnonzero(h >> np.uint32(32 - LOOSE_BITS) == 0) + 1).tolist()
    strict.append(n + MOST)
    loose.append(n + MOST)
    i = j = 0
    while at < n:
        while strict[i] < at + LEAST:
            i += 1
        end = strict[i]
        if end > at + USUAL:
            while loose[j] <= at + USUAL:
                j += 1
            end = min(loose[j], at + MOST)
        at = min(end, n)
        out.append(at)
    return out


def chunks(data: bytes) -> dict[bytes, int]:
    """Each different chunk's code (the beginning of its digest, and its length) and its length in bytes."""
    out, at = {}, 0
    digest = xxhash.xxh3_64_digest
    for end in boundaries(data):
        out[digest(data[at:end])[: DIGITS // 2] + bytes((end - at,))] = end - at
        at = end
    return out


def fingerprint(parts: dict[bytes, int]) -> str:
    return b"".join(sorted(parts)).hex()


def parse(text: str) -> dict[bytes, int]:
    """The chunks of a fingerprint."""
    return {c: c[-1] for c in codes(bytes.fromhex(text))}


def codes(held: bytes) -> list[bytes]:
    """The codes that lie one after the other in ``held``."""
    w = DIGITS // 2 + 1
    return [held[i : i + w] for i in range(0, len(held), w)]


def changed(own: dict[bytes, int], parts: dict[bytes, int]) -> tuple[bytes, bytes, bytes]:
    """The codes of a text, which of them its edited text lost (a bit each), and the codes that it got."""
    mine = sorted(own)
    lost = np.packbits([c not in parts for c in mine]).tobytes() if mine else b""
    return b"".join(mine), lost, b"".join(c for c in parts if c not in own)


def restored(own: bytes, lost: bytes, got: bytes) -> tuple[str, str]:
    """Both fingerprints."""
    mine = codes(own)
    gone = np.unpackbits(np.frombuffer(lost, np.uint8), count=len(mine)).tolist() if mine else []
    edited = [c for c, g in zip(mine, gone, strict=True) if not g] + codes(got)
    return own.hex(), b"".join(sorted(edited)).hex()


def likeness(a: dict[bytes, int], b: dict[bytes, int]) -> float:
    """Shared bytes over the bytes of the smaller set; 1 for two empty sets, 0 for one."""
    if not a or not b:
        return float(not a and not b)
    small, large = (a, b) if len(a) < len(b) else (b, a)
    return sum(n for k, n in small.items() if k in large) / min(sum(a.values()), sum(b.values()))


def resemblance(a: dict[bytes, int], b: dict[bytes, int]) -> float:
    """Shared bytes over all bytes of two chunk sets."""
    if not a and not b:
        return 1.0
    shared = sum(n for k, n in a.items() if k in b) if len(a) < len(b) else sum(n for k, n in b.items() if k in a)
    return shared / (sum(a.values()) + sum(b.values()) - shared)


def containment(a: dict[bytes, int], b: dict[bytes, int]) -> float:
    """Shared bytes over the bytes of ``a``."""
    if not a:
        return 1.0
    return sum(n for k, n in a.items() if k in b) / sum(a.values())


def edit(text: str, following: str) -> str:
    """The last half of the code points replaced by the first as many of the next text."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


def _row(text: str, following: str, own: dict[bytes, int], other: dict[bytes, int]) -> tuple:
    edited = edit(text, following)
    data = edited.encode("utf-8", "surrogatepass")
    parts = own if edited == text else chunks(data)
    return (
        len(text),
        hashlib.sha256(data).hexdigest(),
        *changed(own, parts),
        likeness(own, parts),
        likeness(own, other),
    )


def _parts(text: str) -> dict[bytes, int]:
    return chunks(text.encode("utf-8", "surrogatepass"))


def with_next(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next of each row."""
    kind = docs.schema[key].dataType.simpleString()
    fields = "n_chars bigint, edited_sha256 string, own binary, lost binary, got binary, near_edited double, near_next double"
    # Rows of one id are spread by their text's beginning.
    rows = docs.select(F.col(key).alias("key"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    size = rows.agg(F.sum(F.octet_length("text") + 16)).first()[0] or 0
    parts = max(1, -(-int(size) // PARTITION_BYTES))
    order = [F.col("key").asc_nulls_first(), F.col("text")]
    ordered = rows.repartitionByRange(parts, F.col("key").asc_nulls_first(), F.substring("text", 1, 32)).sortWithinPartitions(*order)
    names = ["key", *(f.split()[0] for f in fields.split(", ")), "part", "edge", "text"]

    def batch_of(keys, done, part, edge, texts, key_type):
        columns = list(zip(*done, strict=True)) if done else [[]] * 7
        kinds = [pa.int64(), pa.string(), pa.binary(), pa.binary(), pa.binary(), pa.float64(), pa.float64()]
        n = len(keys)
        return pa.RecordBatch.from_arrays(
            [pa.array(keys, key_type), *(pa.array(c, t) for c, t in zip(columns, kinds, strict=True)), pa.array([part] * n, pa.int32()), pa.array([edge] * n, pa.string()), pa.array(texts, pa.string())],
            names=names,
        )

    def walk(batches):
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        last, key_type = None, None
        for batch in batches:
            key_type = batch.schema.field(0).type
            for lo in range(0, batch.num_rows, 256):
                some = batch.slice(lo, 256)
                keys, done = [], []
                for k, t in zip(some.column(0).to_pylist(), some.column(1).to_pylist(), strict=True):
                    own = _parts(t)
                    if last is None:
                        yield batch_of([None], [(None,) * 7], part, "first", [t], key_type)
                    else:
                        keys.append(last[0])
                        done.append(_row(last[1], t, last[2], own))
                    last = (k, t, own)
                yield batch_of(keys, done, part, None, [None] * len(keys), key_type)
        if last is not None:
            yield batch_of([last[0]], [(None,) * 7], part, "last", [last[1]], key_type)

    schema = f"key {kind}, {fields}, part int, edge string, text string"
    held = written(ordered.mapInArrow(walk, schema), "fingerprints")
    # Two rows for each partition: its last document meets the first of the next one that has any.
    firsts = held.where("edge = 'first'").select("part", F.col("text").alias("following"))
    after = firsts.select("part", F.lead("part").over(Window.orderBy("part")).alias("_next"), F.min("part").over(Window.partitionBy(F.lit(0))).alias("_least"))
    heads = after.select("part", F.coalesce("_next", "_least").alias("_at")).join(firsts.withColumnRenamed("part", "_at"), "_at").drop("_at")
    lasts = held.where("edge = 'last'").select("key", "text", "part").join(heads, "part")

    def close(batches):
        for batch in batches:
            keys, done = batch.column(0), []
            for t, n in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                done.append(_row(t, n, _parts(t), _parts(n)))
            out = batch_of([None] * len(done), done, 0, None, [None] * len(done), keys.type)
            yield pa.RecordBatch.from_arrays([keys, *out.columns[1:8]], names=names[:8])

    closed = lasts.select("key", "text", "following").mapInArrow(close, f"key {kind}, {fields}")
    every = held.where("edge is null").select(*names[:8]).unionByName(closed)

    def finish(batches):
        for batch in slices(batches):
            both = [restored(*row) for row in zip(*(batch.column(k).to_pylist() for k in (3, 4, 5)), strict=True)]
            prints = [pa.array([b[k] for b in both], pa.string()) for k in (0, 1)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], *prints, *batch.columns[6:]], names=[key, "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"])

    out = f"`{key}` {kind}, n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    return every.mapInArrow(finish, out)
