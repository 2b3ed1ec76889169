"""Template deduction against a brute-force reading and pages whose tags and names say nothing."""

import collections
import random

from lathework.llm import html_extract as h

WORDS = "the of and water moves along old stones while people watch from high bridges near town".split()


def prose(rng, n):
    return " ".join(rng.choice(WORDS) for _ in range(n)).capitalize() + "."


def bare_page(rng, i):
    """A page of plain div and p: menu, advert, story with a title, related links, foot; and the story's text."""
    menu = "".join(f"<li><a href=/{k}>{w}</a></li>" for k, w in enumerate(WORDS[:5]))
    title = f"{prose(rng, 4)} {i}"
    story = [f"{prose(rng, rng.randint(8, 40))} {i}" for _ in range(rng.randint(1, 6))]
    links = "".join(f"<li><a href=/{i}/{k}>{prose(rng, 3)}</a></li>" for k in range(3))
    body = "".join(f"<p>{p}</p>" for p in story)
    html = (
        f"<html><body><div><ul>{menu}</ul></div><div>{prose(rng, 3)}</div>"
        f"<div><h1>{title}</h1>{body}<ul>{links}</ul></div><div><p>All rights stay here</p></div></body></html>"
    )
    return html, " ".join([title, *story])


def test_main_text_by_template_alone(spark):
    rng = random.Random(4)
    rows, truth = [], {}
    for i in range(40):
        html, truth[i] = bare_page(rng, i)
        rows.append((i, f"http://{'ab'[i % 2]}.example/{i}", html))
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {r.page_id: r.text for r in h.extract(df).collect()}
    assert got == truth
    # Without the template the same pages give menus, adverts or feet too.
    assert all(h.text_of(html) != truth[i] for i, _, html in rows)


def test_repeated_text_goes_and_the_article_s_stays(spark):
    rng = random.Random(5)
    plain = [(i, "http://x/", f"<body><div><p>Read this first</p><p>{prose(rng, 20)} {i}</p></div><div>Foot</div></body>") for i in range(10)]
    named = [(100 + i, "http://y/", f"<body><article><p>Read this first</p><p>{prose(rng, 20)} {i}</p></article><div>Foot</div></body>") for i in range(10)]
    got = {r.page_id: r.text for r in h.extract(spark.createDataFrame(plain + named, "page_id long, url string, html string")).collect()}
    assert not any("first" in got[i] or "Foot" in got[i] for i in range(10))
    assert all(got[100 + i].startswith("Read this first") and "Foot" not in got[100 + i] for i in range(10))


def test_classes_equal_brute_force(spark):
    rng = random.Random(6)
    rows = [(f"{'ab'[i % 2]}", bare_page(rng, i % 15)[0]) for i in range(24)]
    held = h.streams(spark.createDataFrame(rows, "host string, html string"), "host", "html")
    got = collections.defaultdict(set)
    for r in h.occurrences(held).collect():
        got[(r.host, r.vector, r.pages)].add(r.token)
    want = collections.defaultdict(set)
    for host in "ab":
        pages = [collections.Counter(h.stream_of(h.events(html))[0]) for own, html in rows if own == host]
        for token in set().union(*pages):
            want[(host, tuple(p[token] for p in pages))].add(token)
    # Equal pages count each, so the vectors over rows are the classes.
    assert sorted(map(sorted, got.values())) == sorted(map(sorted, want.values()))


def test_classes_must_be_ordered_and_nested():
    assert h.order_of([1, 2, 3, 1, 2, 3]) == h.order_of([1, 2, 3]) != 0
    assert h.order_of([1, 2, 2, 1]) == 0
    assert h.crossings([(0, 4, 1), (2, 6, 2), (1, 1, 3)]) == {2}
    assert h.crossings([(0, 9, 1), (2, 6, 2), (3, 4, 3), (7, 8, 2)]) == set()

    def page(n, *orders):
        t = [{"token": k, "class": 1, "pages": n, "text": 0} for k in (11, 12, 13)]
        slot = {"is_class": 0, "class": 0, "flags": h._BOX, "plain": 0, "main": 0, "boiler": 0, "links": 0}
        rows = [{"is_class": 1, "class": 1, "element": 0, "order_least": min(orders), "order_most": max(orders), "tags_least": min(orders), "tags_most": max(orders), "crosses": 0}]
        rows += [{**slot, "element": 11, "around": 0}, {**slot, "element": 12, "around": 11, "plain": 90}, {**slot, "element": 13, "around": 11, "plain": 5}]
        return h.settle(n, t, rows)

    found = page(6, 7, 7)
    assert found["main"] == 12 and found["tree"] == {11: 0, 12: 11, 13: 11}
    assert page(6, 7, 8)["main"] == 0


def test_hosts_of_any_share_and_clashing_columns(spark, monkeypatch):
    from pyspark.sql import functions as F

    from lathework.llm import common

    monkeypatch.setattr(common, "HOT_ROWS", 5)
    monkeypatch.setattr(common, "HOT_SHARE", 8)
    rng = random.Random(7)
    rows, truth = [], {}
    for i in range(60):
        html, truth[i] = bare_page(rng, i)
        rows.append((i, f"http://{'hot' if i % 3 else f'h{i % 4}'}.example/{i}", html))
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    for name in ("host", "_page", "_main", "mark", "all_pages", "fixed", "_row"):
        df = df.withColumn(name, F.lit("clash"))
    got = h.extract(df)
    assert {"host", "mark", "all_pages", "_row"} <= set(got.columns)
    assert {r.page_id: r.text for r in got.collect()} == truth
