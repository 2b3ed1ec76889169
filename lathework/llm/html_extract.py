"""Main text of web pages by equivalence-class template deduction.

Pages of one host come from one template.  Each page becomes a stream of tokens
in page order: opening tags with their place in the tree (the path of labels
above them), and text blocks at their place.

1. Occurrence vectors.  A token's vector is how often it stands in each page of
   the host; tokens with equal vectors form an equivalence class.  A vector is
   kept as the sum of one hash for each (page, count), so Spark adds vectors up
   map-side and no host's pages meet in one task.
   Elements with one place that stand equally often, twice or more, in every
   page are different parts of the template: they are told apart by their number
   (a second count of the stored streams), those whose count varies are records.
2. Valid classes.  A class is large (two tokens or more) and frequent (in two
   pages and in ``SHARE`` of the host's), ordered (in every page its tokens come
   in the same order, once or over and over) and nested (all its tokens have one
   template element around them, and its instances do not cross another
   class's).  Of a class that only its texts put out of order, the tags stay.
3. Template.  The elements of valid classes form a tree: the root class (once in
   each page) and, in the gaps of its elements, the other classes.  Text of a
   valid class is template; what else stands under an element is its slot.
4. The main slot.  A slot weighs its varying text outside links, over all pages.
   From the root the way goes down into the element that holds ``DESCEND`` of
   the weight, as long as there is one.  Names and tags are a prior on the
   weight (``PRIOR`` times for an ``article`` or ``main``, one ``PRIOR``-th for a
   ``nav``, ``footer`` or a class that names such a part), so where they say
   nothing the template decides alone.
5. Extraction.  A page's text is what stands under the main element, without
   the template's texts and without elements inside it that hold links only or
   that their tags and names call a notice, advert, form or comment.  An element
   that its own tag calls the article gives all its text: a line that many
   articles repeat is still the article's.

A page of a host without a template (one page only, or pages of many kinds), or
without the main element, is read by its own tags.

Text: scripts, styles, comments and markup go, character references are
decoded, each block's white space becomes one space, blocks are joined by one
space.

Defined results: a null or empty html gives the empty text; pages without a url
form one host; equal pages are extracted each; unclosed and stray tags are read
as browsers read them (a paragraph ends the one before); a page of any length is
read whole; other columns are carried along, whatever their names; an empty
table gives no row.
"""

from __future__ import annotations

import html as _html
import re

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import mix64, skewed_join, slices, written

#: Share of a host's pages that a class must be in; that a text must be in to be template text, and of how many pages at least.
SHARE = 0.6
REPEATED, REPEATED_PAGES = 0.9, 5
#: Share of a block's or slot's text inside links that makes it a list of links.
LINKS = 0.6
#: Share of the weight that an element must hold for the way to go down into it, and what a telling tag or name counts.
DESCEND, PRIOR = 0.6, 20

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<(script|style|noscript|template|svg|iframe|textarea|select|title)\b[^>]*>.*?(?:</\1\s*>|\Z)"
    r"|<![^>]*>|<\?[^>]*>|</?[a-zA-Z](?:[^>\"']|\"[^\"]*\"|'[^']*')*>|<(?=[^a-zA-Z/!?])|[^<]+|<",
    re.S | re.I,
)
_TAG = re.compile(r"<(/?)([a-zA-Z][^\s/>]*)(.*?)/?>\Z", re.S)
_NAMES = re.compile(r"""(?:\s|^)(class|id|role|hidden|aria-hidden|style|itemprop)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+)))?""", re.I)

#: Tags that end no block.
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small "
    "span strike strong sub sup time tt u var wbr".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Tags that are never the main text.
BOILER_TAGS = frozenset("nav footer aside form button menu dialog head header noscript option".split())
MAIN_TAGS = frozenset("article main".split())
#: Parts of class, id and role names that mark boilerplate.
BOILER_NAMES = frozenset(
    "ad ads adv advert adverts advertisement advertising banner banners breadcrumb breadcrumbs byline comment comments "
    "contentinfo cookie cookies consent copyright disqus footer footnav form gdpr header hidden login masthead menu menus "
    "modal nav navbar navigation newsletter notice notices notification overlay pager paginator pagination paywall popup "
    "promo promoted promotion recommend recommended related reply replies respond search share sharing shoutbox sidebar "
    "sidenav signup skip social sponsor sponsored sponsors subscribe subscription tags toolbar tooltip topbar widget "
    "widgets alert complementary".split()
)
_PART = re.compile(r"[a-z]+")
_CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")

#: A new one of these ends an open one of those, up to the nearest container.
_ENDS = {
    "li": {"li"}, "p": {"p"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"},
    "option": {"option"}, "body": {"head"},
}
_ENDS_P = frozenset("address article aside blockquote details div dl fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split())
_SCOPE = frozenset("article aside body div dl fieldset footer form header html main nav ol section table td th ul".split())


#: Elements that the way to the main text may go down into.
BOXES = frozenset("article body center div main section table tbody td tr".split())


class Element:
    """An open block: its place in the tree and its role."""

    __slots__ = ("name", "place", "own", "boiler", "main", "parent", "index")

    def __init__(self, name: str, attributes: str, parent: Element | None, index: int = -1):
        self.name = name
        self.parent = parent
        self.index = index
        found = {k.lower(): (a or b or c or "") for k, a, b, c in _NAMES.findall(attributes)} if attributes else {}
        parts = set(_PART.findall(_CAMEL.sub(" ", f"{found.get('class', '')} {found.get('id', '')} {found.get('role', '')}").lower()))
        label = f"{name}.{'.'.join(sorted(parts))}" if parts else name
        self.place = _signed(xxhash.xxh3_64_intdigest(label, (parent.place if parent else 0) & (2**63 - 1)))
        hidden = "hidden" in found or found.get("aria-hidden") == "true" or "display:none" in found.get("style", "").replace(" ", "").lower()
        up_main = bool(parent and parent.main)
        # A header inside an article holds the article's title; its name must then say more.
        self.own = name in BOILER_TAGS and not (name == "header" and up_main) or hidden or name != "html" and name != "body" and bool(parts & BOILER_NAMES) and name not in MAIN_TAGS
        self.boiler = bool(parent and parent.boiler) or self.own
        self.main = up_main or not self.boiler and (name in MAIN_TAGS or "main" in parts and name != "body" or found.get("itemprop", "").lower() == "articlebody")


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def events(page: str | None) -> list[tuple[Element, str | None, bool]]:
    """The page in order: each element that opens (no text), and each block: the element around, its text
    (decoded, one space for white space), whether it is links."""
    out: list[tuple[Element, str | None, bool]] = []
    root = Element("html", "", None)
    stack: list[Element] = [root]
    words: list[str] = []
    linked, links = 0, 0

    def flush():
        nonlocal linked
        text = " ".join("".join(words).split())
        if text:
            out.append((stack[-1], text, linked >= LINKS * len(text)))
        words.clear()
        linked = 0

    for m in _TOKEN.finditer(page or ""):
        token = m[0]
        if token[0] != "<" or len(token) == 1:
            text = _html.unescape(token)
            words.append(text)
            if links:
                linked += len(text.strip())
            continue
        if token[1] in "!?" or m[1]:
            if m[1] and m[1].lower() not in ("script", "style", "noscript", "template", "title"):
                words.append(" ")
            continue
        t = _TAG.match(token)
        if not t:
            continue
        close, name = t[1], t[2].lower()
        if name in INLINE:
            if name == "a":
                links = max(0, links + (-1 if close else 1))
            continue
        if name == "br":
            words.append(" ")
            continue
        flush()
        links = 0
        if close:
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].name == name:
                    del stack[i:]
                    break
            continue
        if name in VOID or name in ("html", "body") and any(e.name == name for e in stack[1:]):
            continue
        if name == "html":
            continue
        ends = _ENDS.get(name, frozenset())
        if name in _ENDS_P:
            ends = ends | {"p"}
        if ends:
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].name in ends:
                    del stack[i:]
                    break
                if stack[i].name in _SCOPE and name != "body":
                    break
        stack.append(Element(name, t[3], stack[-1], len(out)))
        out.append((stack[-1], None, False))
    flush()
    return out


def blocks(page: str | None) -> list[tuple[Element, str, bool]]:
    """The page's blocks in order."""
    return [x for x in events(page) if x[1] is not None]


def text_token(text: str, place: int) -> int:
    return _signed(xxhash.xxh3_64_intdigest(text.encode("utf-8", "surrogatepass"), place & (2**63 - 1)))


_STREAM = "host string, mark bigint, tokens array<bigint>, up array<int>, chars array<int>, flags array<int>"
_TEXT, _LINK, _BOILER, _MAIN, _BOX = 1, 2, 4, 8, 16


def stream_of(found: list[tuple[Element, str | None, bool]]) -> tuple[list[int], list[int], list[int], list[int]]:
    """A page's tokens, the number of the element around each (-1: none), characters and flags."""
    tokens, up, chars, flags = [], [], [], []
    for e, text, linked in found:
        role = (_BOILER if e.boiler else _MAIN if e.main else 0) | (_BOX if e.name in BOXES else 0)
        if text is None:
            tokens.append(e.place)
            up.append(e.parent.index)
            chars.append(0)
            flags.append(role)
        else:
            tokens.append(text_token(text, e.place))
            up.append(e.index)
            chars.append(len(text))
            flags.append(role | _TEXT | (_LINK if linked else 0))
    return tokens, up, chars, flags


def told_apart(tokens: list[int], up: list[int], flags: list[int], fixed: set[int]) -> list[int]:
    """The tokens, where elements of the places in ``fixed`` and all that lies in them are named by their number too."""
    if not fixed:
        return tokens
    out = list(tokens)
    number: dict[tuple[int, int], int] = {}
    for i, token in enumerate(tokens):
        j = up[i]
        n = 0
        if token in fixed and not flags[i] & _TEXT:
            n = number[(j, token)] = number.get((j, token), 0) + 1
        if n or j >= 0 and out[j] != tokens[j]:
            out[i] = _signed(xxhash.xxh3_64_intdigest(np.array([token, n, out[j] if j >= 0 else 0], np.int64).tobytes()))
    return out


def streams(pages: DataFrame, host: str, page: str) -> DataFrame:
    """One row a page: its tokens in order, the number of the element around each, characters and flags."""

    def read(batches):
        for batch in slices(batches):
            out = ([], [], [], [], [], [])
            for h, body in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                tokens, up, chars, flags = stream_of(events(body))
                mark = _signed(xxhash.xxh3_64_intdigest((body or "").encode("utf-8", "surrogatepass")))
                for column, value in zip(out, (h, mark, tokens, up, chars, flags), strict=True):
                    column.append(value)
            kinds = [pa.string(), pa.int64(), pa.list_(pa.int64()), *[pa.list_(pa.int32())] * 3]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds, strict=True)], names=["host", "mark", "tokens", "up", "chars", "flags"])

    return pages.select(F.col(host), F.col(page)).mapInArrow(read, _STREAM)


def occurrences(held: DataFrame) -> DataFrame:
    """Each token's occurrence vector over the pages of its host: host, token, vector, pages, its least and most counts, flags."""

    def count(batches):
        for batch in batches:
            hosts = batch.column(0).dictionary_encode()
            mark = batch.column(1).to_numpy().view(np.uint64)
            lists = batch.column(2)
            token = lists.flatten().to_numpy()
            flag = batch.column(3).flatten().to_numpy()
            page = np.repeat(np.arange(len(lists)), lists.value_lengths().to_numpy())
            # How often each token stands in each page.
            order = np.lexsort((token, page))
            token, page, flag = token[order], page[order], flag[order]
            new = np.append(True, (page[1:] != page[:-1]) | (token[1:] != token[:-1])) if len(token) else np.empty(0, bool)
            at = np.flatnonzero(new)
            n = np.diff(np.append(at, len(token)))
            token, page, flag = token[at], page[at], flag[at] & (_TEXT | _BOX)
            # A batch has few enough pages for sums of 48 bits.
            h = (mix64(mix64(n.astype(np.uint64)) ^ mark[page]) >> np.uint64(16)).astype(np.int64)
            host = hosts.indices.to_numpy()[page].astype(np.int64)
            order = np.lexsort((token, host))
            token, host, h, flag, n = token[order], host[order], h[order], flag[order], n[order]
            at = np.flatnonzero(np.append(True, (host[1:] != host[:-1]) | (token[1:] != token[:-1]))) if len(token) else np.empty(0, int)
            sums, least, most = (f.reduceat(x, at) if len(at) else np.empty(0, np.int64) for f, x in ((np.add, h), (np.minimum, n), (np.maximum, n)))
            yield pa.RecordBatch.from_arrays(
                [
                    hosts.dictionary.take(pa.array(host[at])) if len(at) else pa.array([], pa.string()),
                    pa.array(token[at]), pa.array(sums), pa.array(np.diff(np.append(at, len(token)))), pa.array(least), pa.array(most), pa.array(flag[at].astype(np.int32)),
                ],
                names=["host", "token", "vector", "pages", "least", "most", "flags"],
            )

    rows = held.select("host", "mark", "tokens", "flags").mapInArrow(count, "host string, token bigint, vector bigint, pages bigint, least bigint, most bigint, flags int")
    return rows.groupBy("host", "token").agg(
        F.sum(F.col("vector").cast("decimal(20,0)")).alias("vector"), F.sum("pages").alias("pages"), F.min("least").alias("least"), F.max("most").alias("most"), F.max("flags").alias("flags")
    )


def order_of(tokens: list[int]) -> int:
    """A hash of the order of a class's tokens in a page; 0 when its instances differ in order."""
    m = tokens.index(tokens[0], 1) if tokens[0] in tokens[1:] else len(tokens)
    first = tokens[:m]
    if len(tokens) % m or first * (len(tokens) // m) != tokens:
        return 0
    return _signed(xxhash.xxh3_64_intdigest(np.array(first, np.int64).tobytes()) | 1)


def crossings(spans: list[tuple[int, int, int]]) -> set[int]:
    """Classes with an instance (start, end, class) that crosses, without lying in it, one of a class before."""
    out: set[int] = set()
    open_: list[tuple[int, int]] = []
    for start, end, own in sorted(spans):
        while open_ and open_[-1][0] < start:
            open_.pop()
        if open_ and open_[-1][0] < end and open_[-1][1] != own:
            out.add(own)
        open_.append((end, own))
        open_.sort(reverse=True)
    return out


_EVIDENCE = ("order_least", "order_most", "tags_least", "tags_most", "crosses")
_SUMS = ("plain", "main", "boiler", "links")


def evidence_of(tokens: list[int], up: list[int], chars: list[int], flags: list[int], classes: dict[int, int]):
    """What one page says of its host's classes: {class: (order, order of its tags, whether it crosses)} and
    {element: [the element around, flags, characters by role, in links]} (0: no element around)."""
    own = [classes.get(t) for t in tokens]
    seen: dict[int, list[int]] = {}
    for i, c in enumerate(own):
        if c is not None:
            seen.setdefault(c, []).append(i)
    spans = []
    said: dict[int, tuple[int, int, int]] = {}
    for c, at in seen.items():
        tags = [i for i in at if not flags[i] & _TEXT]
        n = at.index(next((i for i in at[1:] if tokens[i] == tokens[at[0]]), at[0])) or len(at)
        spans += [(at[k], at[min(k + n, len(at)) - 1], c) for k in range(0, len(at), n)] if n < len(at) else []
        said[c] = (order_of([tokens[i] for i in at]), order_of([tokens[i] for i in tags]) if tags else 0, 0)
    for c in crossings(spans) if spans else ():
        said[c] = (*said[c][:2], 1)
    inner = [0] * len(tokens)
    slots: dict[int, list[int]] = {}
    for i, token in enumerate(tokens):
        j = up[i]
        around = inner[j] if j >= 0 else 0
        if flags[i] & _TEXT:
            if own[i] is None:
                slot = slots.setdefault(around, [0, 0, 0, 0, 0, 0])
                slot[2 if flags[i] & (_MAIN | _BOILER) == 0 else 3 if flags[i] & _MAIN else 4] += 0 if flags[i] & _LINK else chars[i]
                slot[5] += chars[i] if flags[i] & _LINK else 0
        elif own[i] is not None:
            slot = slots.setdefault(token, [0, 0, 0, 0, 0, 0])
            slot[0], slot[1] = around, flags[i]
            inner[i] = token
        else:
            inner[i] = around
    return said, slots


def evidence(held: DataFrame) -> DataFrame:
    """The pages' evidence summed up: a row for each class (element 0) and each element of a host's candidate classes."""

    def look(batches):
        for batch in slices(batches, 512):
            rows: dict[tuple, list] = {}
            for host, tokens, up, chars, flags, known, of in zip(*(batch.column(k).to_pylist() for k in range(7)), strict=True):
                said, slots = evidence_of(tokens, up, chars, flags, dict(zip(known, of, strict=True)))
                for c, (order, tags, crosses) in said.items():
                    r = rows.setdefault((host, c, 0, 1), [order, order, tags, tags, crosses, 0, 0, 0, 0, 0, 0])
                    r[:5] = [min(r[0], order), max(r[1], order), min(r[2], tags), max(r[3], tags), max(r[4], crosses)]
                for place, (around, flag, *sums) in slots.items():
                    r = rows.setdefault((host, 0, place, 0), [0, 0, 0, 0, 0, around, flag, 0, 0, 0, 0])
                    r[7:] = [a + b for a, b in zip(r[7:], sums, strict=True)]
            keys, values = list(rows), list(rows.values())
            yield pa.RecordBatch.from_arrays(
                [pa.array([k[0] for k in keys], pa.string()), *(pa.array([k[i] for k in keys], pa.int64()) for i in (1, 2, 3)), *(pa.array([v[i] for v in values], pa.int64()) for i in range(11))],
                names=["host", "class", "element", "is_class", *_EVIDENCE, "around", "flags", *_SUMS],
            )

    names = ("class", "element", "is_class", *_EVIDENCE, "around", "flags", *_SUMS)
    rows = held.mapInArrow(look, ", ".join(["host string", *(f"`{n}` bigint" for n in names)]))
    least = [F.min(n).alias(n) for n in ("order_least", "tags_least")]
    most = [F.max(n).alias(n) for n in ("order_most", "tags_most", "crosses")]
    return rows.groupBy("host", "class", "element", "is_class").agg(
        *least, *most, F.max_by("around", F.abs("around")).alias("around"), F.max("flags").alias("flags"), *[F.sum(n).alias(n) for n in _SUMS]
    )


def settle(all_pages: int, tokens: list[dict], rows: list[dict]) -> dict:
    """A host's template from its candidate tokens and the pages' evidence.

    Gives the main element (0: none), whether its tag says that it is the
    article, the elements inside it that hold links only, the template's texts,
    and the template's elements with the element around each.
    """
    said = {r["class"]: r for r in rows if r["is_class"]}
    around = {r["element"]: r["around"] for r in rows if not r["is_class"]}
    slots = {r["element"]: r for r in rows if not r["is_class"]}
    members: dict[int, list[dict]] = {}
    for t in tokens:
        members.setdefault(t["class"], []).append(t)
    valid: set[int] = set()
    texts: set[int] = set()
    for c, own in members.items():
        r = said.get(c)
        if r is None or r["crosses"]:
            continue
        tags = {t["token"] for t in own if not t["text"]}
        ordered = r["order_least"] == r["order_most"] != 0
        if not ordered and (r["tags_least"] != r["tags_most"] or r["tags_least"] == 0 or len(tags) < 2):
            continue
        # Nested: the elements around the class's own are one.
        outer = set()
        for t in tags:
            a = around.get(t, 0)
            while a in tags:
                a = around.get(a, 0)
            outer.add(a)
        if len(outer) > 1:
            continue
        valid |= tags
        if ordered and all_pages >= REPEATED_PAGES and own[0]["pages"] >= REPEATED * all_pages:
            texts |= {t["token"] for t in own if t["text"]}

    def up(place: int) -> int:
        a = around.get(place, 0)
        while a and a not in valid:
            a = around.get(a, 0)
        return a

    weight: dict[int, float] = {}
    links: dict[int, int] = {}
    chars: dict[int, int] = {}
    inside: dict[int, list[int]] = {}
    for place in valid:
        inside.setdefault(up(place), []).append(place)
    for place, r in slots.items():
        w = r["plain"] + PRIOR * r["main"] + r["boiler"] / PRIOR
        a = place if place in valid else up(place)
        while True:
            weight[a] = weight.get(a, 0) + w
            links[a] = links.get(a, 0) + r["links"]
            chars[a] = chars.get(a, 0) + r["plain"] + r["main"] + r["boiler"]
            if not a:
                break
            a = up(a)
    at, article = 0, False
    while not article:
        best = max(inside.get(at, ()), key=lambda p: (weight.get(p, 0), p), default=0)
        if not best or not slots[best]["flags"] & _BOX or weight.get(best, 0) <= 0 or weight[best] < DESCEND * weight[at]:
            break
        at, article = best, bool(slots[best]["flags"] & _MAIN)
    below, lists = [at], []
    while below:
        for p in inside.get(below.pop(), ()):
            if not article and links.get(p, 0) >= LINKS * (links.get(p, 0) + chars.get(p, 0)):
                lists.append(p)
            else:
                below.append(p)
    return {"main": at, "article": article, "lists": sorted(lists), "repeated": sorted(texts), "tree": {p: up(p) for p in valid}}


def numbered(held: DataFrame, hosts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The streams with the parts of each host's template told apart, and each host with its pages and these places."""
    found = occurrences(held).where(f"pages >= {REPEATED_PAGES} and least = most and least > 1 and (flags & {_TEXT}) = 0 and (flags & {_BOX}) != 0")
    # Fewer places than a page's mean length over SHARE: a host's list is bounded.
    some = found.join(hosts, "host").where(F.col("pages") >= SHARE * F.col("all_pages")).groupBy("host").agg(F.array_sort(F.collect_list("token")).alias("fixed"))
    places = written(hosts.join(some, "host", "left").select("host", "all_pages", "fixed"), "page-places")
    joined = skewed_join(held, places, "host", "all_pages").select(*held.columns, "fixed")

    names = held.columns

    def rename(batches):
        for batch in slices(batches, 512):
            lists = [batch.column(k).to_pylist() for k in (2, 3, 5, 6)]
            out = [told_apart(t, u, f, set(x or ())) for t, u, f, x in zip(*lists, strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(out, pa.list_(pa.int64())), *batch.columns[3:6]], names=names)

    return written(joined.mapInArrow(rename, _STREAM), "page-streams"), places


def deduce(held: DataFrame) -> DataFrame:
    """One row for each host of written ``streams``: its pages and its template (main: null where there is none)."""
    held, hosts = numbered(held, held.groupBy("host").agg(F.count(F.lit(1)).alias("all_pages")))
    # A token in one page only is in no frequent class; leaving these here keeps the rest small.
    found = written(occurrences(held).where("pages >= 2").withColumn("text", F.col("flags").bitwiseAND(_TEXT)), "page-tokens")
    own = found.join(hosts.drop("fixed"), "host").where(F.col("pages") >= SHARE * F.col("all_pages"))
    # Tokens that most pages have are fewer than a page's mean length over SHARE, so a host's list is bounded.
    listed = own.groupBy("host").agg(F.max("all_pages").alias("all_pages"), F.collect_list(F.struct("token", F.xxhash64("vector", "pages").alias("class"), "pages", "text")).alias("all"))
    large = lambda t: F.size(F.filter("all", lambda x: x["class"] == t["class"])) >= 2
    listed = written(listed.select("host", "all_pages", F.filter("all", large).alias("tokens")).where(F.size("tokens") > 0), "page-classes")
    known = listed.select("host", "all_pages", F.col("tokens.token").alias("known"), F.col("tokens.class").alias("of"))
    joined = skewed_join(held.select("host", "tokens", "up", "chars", "flags"), known, "host", "all_pages")
    rows = evidence(joined.select("host", "tokens", "up", "chars", "flags", "known", "of"))
    fields = ("class", "element", "is_class", *_EVIDENCE, "around", "flags", *_SUMS)
    gathered = rows.groupBy("host").agg(F.collect_list(F.struct(*[F.col(f"`{n}`") for n in fields])).alias("rows"))

    def choose(batches):
        for batch in slices(batches, 64):
            found = [settle(n, t, r) for n, t, r in zip(*(batch.column(k).to_pylist() for k in (1, 2, 3)), strict=True)]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pa.array([f["main"] or None for f in found], pa.int64()), pa.array([f["article"] for f in found], pa.bool_()),
                    pa.array([f["lists"] for f in found], pa.list_(pa.int64())), pa.array([f["repeated"] for f in found], pa.list_(pa.int64())),
                ],
                names=["host", "main", "article", "lists", "repeated"],
            )

    chosen = listed.select("host", "all_pages", "tokens").join(gathered, "host").mapInArrow(choose, "host string, main bigint, article boolean, lists array<bigint>, repeated array<bigint>")
    return written(hosts.join(chosen, "host", "left").select("host", "all_pages", "main", "article", "lists", "repeated", "fixed"), "page-templates")


_NONE: frozenset[int] = frozenset()


def text_of(page: str | None, main: int | None = None, article: bool = False, lists: frozenset[int] = _NONE, repeated: frozenset[int] = _NONE, fixed: frozenset[int] = _NONE) -> str:
    """The main text of a page under its host's template (``main`` None: by its own tags)."""
    found = events(page)
    if main is not None:
        tokens, up, _, flags = stream_of(found)
        tokens = told_apart(tokens, up, flags, fixed)
        if any(t == main and f & _TEXT == 0 for t, f in zip(tokens, flags, strict=True)):
            # 0: outside the main element, 1: in it, 2: in a part of it that goes.
            state = [0] * len(found)
            kept = []
            for i, (e, text, linked) in enumerate(found):
                above = state[up[i]] if up[i] >= 0 else 0
                if text is None:
                    state[i] = 1 if tokens[i] == main else 0 if not above else 2 if above == 2 or e.own or tokens[i] in lists else 1
                elif above == 1 and (article or not linked and tokens[i] not in repeated):
                    kept.append(text)
            return " ".join(kept)
    rest = [(e, t, linked) for e, t, linked in found if t is not None and not e.boiler]
    if any(e.main for e, _, _ in rest):
        return " ".join(t for e, t, _ in rest if e.main)
    return " ".join(t for _, t, linked in rest if not linked)


def extract(pages: DataFrame, url: str = "url", page: str = "html") -> DataFrame:
    """``pages`` with ``text`` and ``n_chars`` in place of the html."""
    rest = [c for c in pages.columns if c not in (page, "text", "n_chars", "_page", "_main", "_article", "_lists", "_repeated", "_fixed") or c == url]
    host = F.lower(F.coalesce(F.regexp_extract(F.col(url).cast("string"), r"^\s*(?:[a-zA-Z][\w+.-]*:)?//(?:[^/@?#]*@)?([^/:?#]*)", 1), F.lit("")))
    # The row goes along whole, so no column of it can clash with those made here.
    rows = pages.select(host.alias("host"), F.struct(*[F.col(f"`{c}`") for c in rest]).alias("_row"), F.col(page).cast("string").alias("_page"))
    held = written(streams(rows, "host", "_page"), "page-streams")
    templates = deduce(held).select(
        "host", "all_pages", F.col("main").alias("_main"), F.coalesce("article", F.lit(False)).alias("_article"), F.col("lists").alias("_lists"), F.col("repeated").alias("_repeated"), F.col("fixed").alias("_fixed")
    )
    # A host may hold a third of all pages: such hosts' templates are broadcast, their pages stay where they lie.
    joined = skewed_join(rows, templates, "host", "all_pages").select("_row.*", "_page", "_main", "_article", "_lists", "_repeated", "_fixed")
    schema = joined.drop("_page", "_main", "_article", "_lists", "_repeated", "_fixed").limit(0).withColumn("text", F.lit("")).withColumn("n_chars", F.lit(0).cast("long")).schema
    for field in schema:
        field.nullable = True
    n = len(rest)

    def run(batches):
        for batch in slices(batches):
            out = []
            for h, m, a, *lists in zip(*(batch.column(n + i).to_pylist() for i in range(6)), strict=True):
                out.append(text_of(h, m, a, *(frozenset(x or ()) for x in lists)))
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:n], pa.array(out, pa.string()), pa.array(np.array([len(t) for t in out], np.int64))], names=[f.name for f in schema]
            )

    return joined.mapInArrow(run, schema)
