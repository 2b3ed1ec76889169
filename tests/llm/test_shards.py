"""The two-pass shuffle against a plain reading of its law."""

import collections
import zlib

from lathework.llm import queries, shards

from .helpers import EDGE, random_docs


def test_query_holds_its_law_for_every_row(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(shards, "BUCKET_BYTES", 3000)
    docs = [(d, t) for d, t, _ in EDGE] + [(100 + i, t) for i, t in random_docs(300, 6)]
    spark.createDataFrame(docs, "doc_id long, text string").repartition(5).write.parquet(f"{tmp_path}/documents.parquet")
    got = queries.op4_shards(spark, str(tmp_path)).collect()
    want = collections.Counter((d, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for d, t in docs)
    assert collections.Counter((r.doc_id, r.size, r.text_crc32) for r in got) == want
    assert {r.law for r in got} == {"rows"} and {r.grown_shard for r in got} == {None}
    by = collections.defaultdict(list)
    for r in got:
        by[r.shard].append(r.slot)
    assert sorted(by) == list(range(16))
    assert all(sorted(slots) == list(range(len(slots))) for slots in by.values())
    sizes = [len(s) for s in by.values()]
    assert max(sizes) - min(sizes) <= 1
    # Copies of one text do not come together, and neighbours by id do not either.
    copies = collections.defaultdict(set)
    for r in got:
        copies[r.text_crc32].add(r.shard)
    order = {r.doc_id: (r.shard, r.slot) for r in got if r.doc_id >= 100}
    near = sum(order[i][0] == order[i + 1][0] for i in range(100, 399))
    assert near < 60


def test_the_order_is_a_uniform_draw(spark):
    docs = spark.createDataFrame([(i, f"t{i}") for i in range(60)], "doc_id long, text string")
    first = collections.Counter()
    for seed in range(25):
        rows = shards.shuffle(docs, shards=2, seed=seed).collect()
        first.update(r.doc_id for r in rows if r.shard == 0)
    # Each row is in the first half 12.5 times of 25 on average.
    assert len(first) == 60 and min(first.values()) >= 3 and max(first.values()) <= 22
    assert [tuple(r) for r in shards.shuffle(docs, seed=3).orderBy("shard", "slot").collect()] == [tuple(r) for r in shards.shuffle(docs.repartition(7), seed=3).orderBy("shard", "slot").collect()]
