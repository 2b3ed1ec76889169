"""Nearest vectors, ranked search, whitening: against brute force."""

import collections
import math
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from lathework.llm import ann, queries, ranked, whitening

from .helpers import LONG

# -- 11: nearest vectors ------------------------------------------------------


def clustered(n, dim=24, groups=40, seed=5):
    rng = np.random.default_rng(seed)
    centres = rng.standard_normal((groups, dim)) * 3
    return (centres[rng.integers(0, groups, n)] + rng.standard_normal((n, dim))).astype(np.float32)


def vectors(spark, rows, kind="array<float>"):
    return spark.createDataFrame([(i, None if v is None else [None if x is None else float(x) for x in v]) for i, v in rows], f"vec_id long, embedding {kind}")


def exact(rows, k=20, every=20):
    good = [(i, np.array(v, float)) for i, v in rows if v is not None and None not in list(v) and np.isfinite(np.array(v, float)).all() and np.any(np.array(v, float))]
    out = {}
    for q, v in good:
        if q % every == 0:
            found = sorted((-float(v @ w), i) for i, w in good if i != q)[:k]
            out[q] = [(i, -s) for s, i in found]
    return out


def test_chi_square_quantiles():
    for dims, p, value in [(1, 0.95, 3.841459), (8, 0.95, 15.507313), (8, 0.9, 13.361566), (10, 0.5, 9.341818)]:
        assert ann.chi_square_quantile(p, dims) == pytest.approx(value, abs=1e-5)


@pytest.mark.parametrize("scaled", [False, True])
def test_recall_scores_and_order(spark, scaled):
    v = clustered(3000)
    if scaled:  # norms differ: the largest product is not the nearest direction
        v *= np.random.default_rng(1).uniform(0.2, 1.5, (len(v), 1)).astype(np.float32)
    rows = list(enumerate(v))
    got = ann.neighbours(vectors(spark, rows), lambda c: c % 20 == 0, block_rows=256, chunk=64).collect()
    want, by = exact(rows), collections.defaultdict(list)
    for r in got:
        by[r.query_id].append(r)
    assert set(by) == set(want)
    hits = 0
    for q, found in by.items():
        found.sort(key=lambda r: r["rank"])
        assert [r["rank"] for r in found] == list(range(1, 21)) and q not in [r.vec_id for r in found]
        assert all(r.score == pytest.approx(float(v[q].astype(float) @ v[r.vec_id].astype(float)), rel=1e-12) for r in found)
        assert [(-r.score, r.vec_id) for r in found] == sorted((-r.score, r.vec_id) for r in found)
        hits += len({r.vec_id for r in found} & {i for i, _ in want[q]})
    assert hits >= 0.9 * 20 * len(want)


def test_the_stopping_test_spares_rows_and_keeps_its_promise():
    rng = np.random.default_rng(3)
    v = clustered(4000, dim=32).astype(float)
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    p = v @ ann.projections(32)[:-1]
    block, q = ann.Block(np.arange(len(v)), v, p), rng.choice(len(v), 200, replace=False)
    who, at, _ = block.search(v[q], p[q], np.full(len(q), np.inf), 20, 1.0, ann.chi_square_quantile(ann.TRUST, ann.DIMS))
    assert block.verified < 0.45 * len(q) * len(v)
    best = np.argsort(-(v[q] @ v.T), axis=1)[:, :20]
    hits = sum(len(set(block.ids[at[who == i]]) & set(best[i])) for i in range(len(q)))
    assert hits >= 0.95 * best.size


def test_nearest_with_copies_ties_and_unusable_rows(spark):
    rng = np.random.default_rng(7)
    base = rng.integers(-3, 4, (60, 6)).astype(float)
    base[~base.any(axis=1)] = 1
    rows = [(i, base[i % 60]) for i in range(600)]  # ten copies of each: many equal scores
    rows += [(1000 + i, base[0]) for i in range(300)]  # a third of the rows is one vector
    rows += [(2000, None), (2020, [1.0, None, 0, 0, 0, 0]), (2040, [float("nan")] * 6), (2060, [float("inf")] + [0.0] * 5), (2080, [0.0] * 6), (2100, [1.0] * 5), (2120, [])]
    rows += [rows[0], rows[20]]  # repeated rows count once
    df = vectors(spark, rows, "array<double>").unionByName(spark.createDataFrame([(None, [1.0] * 6)], "vec_id long, embedding array<double>"))
    for name in ("id", "rank", "score", "p", "cell", "norm"):
        df = df.withColumn(name, F.lit("clash"))
    got = ann.neighbours(df, lambda c: c % 20 == 0, block_rows=64).collect()
    by = collections.defaultdict(list)
    for r in got:
        by[r.query_id].append((r["rank"], r.vec_id, r.score))
    want = exact([r for k, r in enumerate(rows) if k < len(rows) - 2 and r[0] not in (2100, 2120)])
    assert {q: [(i, s) for _, i, s in sorted(v)] for q, v in by.items()} == want


def test_nearest_in_tiny_and_empty_tables(spark):
    assert ann.neighbours(vectors(spark, []), lambda c: c % 20 == 0).count() == 0
    assert ann.neighbours(vectors(spark, [(0, None)]), lambda c: c % 20 == 0).count() == 0
    assert ann.neighbours(vectors(spark, [(0, [1.0, 2])]), lambda c: c % 20 == 0).count() == 0
    got = ann.neighbours(vectors(spark, [(0, [1.0, 2]), (1, [3.0, 0]), (20, [-1.0, 1])]), lambda c: c % 20 == 0).collect()
    assert sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in got) == [(0, 1, 1, 3.0), (0, 2, 20, 1.0), (20, 1, 0, 1.0), (20, 2, 1, -3.0)]


# -- 12: ranked search --------------------------------------------------------

TERM = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")
LOWER = {c: c + 32 for c in range(65, 91)}


def ranked_by_hand(docs, items, k=20):
    terms = [(i, d, collections.Counter(TERM.findall((t or "").translate(LOWER)))) for i, (d, t) in enumerate(docs)]
    terms = [(i, d, c) for i, d, c in terms if c]
    n_docs, length, df = len(terms), sum(sum(c.values()) for *_, c in terms), collections.Counter(x for *_, c in terms for x in c)
    out = []
    for item, text in items:
        scores = []
        for i, d, c in terms:
            m, score = 100 - 25 + (25 * sum(c.values()) * n_docs) // length, 0
            for x in TERM.findall((text or "").translate(LOWER)):
                if x in c:
                    score += math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[x] + 1))) * (1000000000 * c[x] // (1000 * c[x] + 12 * m))
            if score > 0:
                scores.append((-score, d, i))
        out += [(item, r + 1, d, -s) for r, (s, d, _) in enumerate(sorted(scores)[:k])]
    return sorted(out, key=repr)


def rows_of(df):
    return sorted(((r.item_id, r["rank"], r.doc_id, r.score) for r in df.collect()), key=repr)


def test_ranked_search_equals_scoring_every_document(spark):
    rng = random.Random(4)
    words = ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 6))) for _ in range(300)]
    weights = [1 / (i + 1) for i in range(300)]
    docs = [(i, " ".join(rng.choices(words, weights, k=rng.randint(1, 120)))) for i in range(500)]
    docs += [(900 + i, "one very common line of words") for i in range(250)]
    items = [(f"q{i}", " ".join(rng.choices(words, weights, k=rng.randint(1, 30)))) for i in range(25)] + [("all", " ".join(words)), ("line", "common line"), ("none", "zzzz")]
    d, b = spark.createDataFrame(docs, "doc_id long, text string").repartition(5), spark.createDataFrame(items, "item_id string, text string")
    index = ranked.build(d, segment=700)
    assert index.postings.groupBy("term").count().agg(F.max("count")).first()[0] > 2  # common lists are split
    want = ranked_by_hand(docs, items)
    assert rows_of(ranked.search(index, b)) == want
    assert rows_of(ranked.search(index, b, block_bytes=30_000)) == want  # the items in several blocks
    assert rows_of(ranked.search(index, b, k=3)) == ranked_by_hand(docs, items, 3)


def test_ranked_search_edges(spark):
    docs = [(1, None), (2, ""), (3, " .,;"), (4, "Apple pie"), (5, "apple PIE"), (5, "apple PIE"), (None, "pie chart é"), (6, LONG), (7, "É é 日本語 apple"), (8, "x" * 5000)]
    items = [("a", "Apple apple"), ("b", "pie, É!"), ("c", None), ("d", "..."), (None, "日本語"), ("a", "word5x5 " + "x" * 5000)]
    d = spark.createDataFrame(docs, "doc_id long, text string").coalesce(1)
    b = spark.createDataFrame(items, "item_id string, text string")
    for name in ("term", "row", "n", "item", "score"):
        d, b = d.withColumn(name, F.lit("clash")), b.withColumn(name, F.lit("clash"))
    want = ranked_by_hand([(math.inf if i is None else i, t) for i, t in docs], items)
    got = ranked.search(ranked.build(d), b)
    assert sorted((r.item_id or "", r["rank"], r.score) for r in got.collect()) == sorted((i or "", r, s) for i, r, _, s in want)
    none = spark.createDataFrame([], "doc_id long, text string")
    assert ranked.search(ranked.build(none), b).count() == 0
    assert ranked.search(ranked.build(d), spark.createDataFrame([], "item_id string, text string")).count() == 0


# -- 13: whitening ------------------------------------------------------------


def whitened_by_hand(v, k=32):
    x = np.floor(64 * np.array(v, float)).astype(np.int64) + 1_000_000
    n = len(x)
    u = n * x - x.sum(axis=0)
    c = u / n
    cov = c.T @ c / n
    e, q = np.linalg.eigh(cov)
    e, q = e[::-1][:k], q[:, ::-1][:, :k]
    return (u.astype(object) ** 2).sum(axis=1), c @ q / np.sqrt(e), e / np.trace(cov)


@pytest.mark.parametrize("dim", [5, 40, 96])
def test_whitening_equals_the_eigenvectors(spark, dim):
    rng = np.random.default_rng(dim)
    v = (rng.standard_normal((400, dim)) * np.linspace(3, 0.5, dim)).astype(np.float32)
    got = whitening.whiten_all(vectors(spark, enumerate(v)).repartition(3)).collect()
    dev, white, share = whitened_by_hand(v)
    k = min(32, dim)
    assert len(got) == 400 * k and {r.n for r in got} == {400}
    out, sign = np.zeros((400, k)), None
    for r in got:
        assert r.deviation == dev[r.vec_id] and r.explained == pytest.approx(share[r.component - 1], rel=1e-9) and 0 <= r.identity_error < 1e-9
        out[r.vec_id, r.component - 1] = r.whitened
    sign = np.sign((out * white).sum(axis=0))
    assert np.allclose(out, white * sign, atol=1e-7)


def test_lanczos_survives_breakdown_and_hidden_multiplicities():
    rng = np.random.default_rng(2)
    q = np.linalg.qr(rng.standard_normal((120, 120)))[0]
    for values in (np.concatenate([np.full(40, 5.0), np.full(80, 1.0)]), np.concatenate([np.arange(3, 0, -1.0), np.zeros(117)]), np.ones(120), np.linspace(9, 1, 120), np.zeros(120)):
        v = q * values @ q.T
        got, vectors_, _ = whitening.lanczos(lambda b, v=v: v @ b, 120, 32, block=8)
        assert np.allclose(got, np.sort(values)[::-1][:32], atol=1e-10)
        assert np.allclose(vectors_.T @ vectors_, np.eye(32), atol=1e-10) and np.allclose(v @ vectors_, vectors_ * got, atol=1e-9)


def test_lanczos_stops_before_the_whole_space():
    rng = np.random.default_rng(6)
    q = np.linalg.qr(rng.standard_normal((400, 400)))[0]
    v = q * (0.5 ** np.arange(400)) @ q.T
    values, _, passes = whitening.lanczos(lambda b: v @ b, 400, 8, block=8)
    assert np.allclose(values, 0.5 ** np.arange(8), rtol=1e-10) and passes < 20


def test_whitening_edges(spark):
    rng = np.random.default_rng(9)
    good = rng.standard_normal((50, 4))
    good[:, 3] = good[:, 0]  # rank 3
    rows = list(enumerate(good)) + [(60, None), (61, [1.0, None, 0, 0]), (62, [float("nan"), 0, 0, 0]), (63, [float("inf"), 0, 0, 0]), (64, [1.0] * 3), (65, [])]
    rows += [(7, good[7]), (70, [0.0] * 4), (71, [3e38, -3e38, 1, 1])]
    df = vectors(spark, rows, "array<double>")
    df = df.unionByName(spark.createDataFrame([(None, [1.0, 2.0, 3.0, 1.0])], "vec_id long, embedding array<double>")).withColumn("n", F.lit("clash")).withColumn("component", F.lit("clash"))
    got = whitening.whiten_all(df.where("coalesce(vec_id, 0) <> 71")).collect()
    assert len(got) == 53 * 3 and {r.n for r in got} == {53} and max(r.identity_error for r in got) < 1e-4
    assert sum(r.vec_id == 7 for r in got) == 6 and sum(r.vec_id == 70 for r in got) == 3 and sum(r.vec_id is None for r in got) == 3
    far = whitening.whiten_all(df).collect()  # entries beyond the largest, sums of squares beyond 64 bits
    assert {r.vec_id for r in far if r.deviation is None} and all(math.isfinite(r.whitened) for r in far)
    assert whitening.whiten_all(vectors(spark, [])).count() == 0
    assert whitening.whiten_all(vectors(spark, [(1, [1.0, 2]), (2, [1.0, 2])])).count() == 0
    wide = np.repeat([[2.0**45] * 4, [-(2.0**45)] * 4], 4, axis=0)
    dev = whitening.deviations(whitening.numerators(whitening.integers(wide), 8, whitening.integers(wide).sum(axis=0)))
    assert dev[0] == 4 * (8 * (1 << 46)) ** 2


def test_search_queries_are_registered(spark, tmp_path):
    assert {"op11_nearest", "op12_ranked_search", "op13_whitening"} <= set(queries.queries()) and "op12_ranked_search" in queries.oracle_sql()
