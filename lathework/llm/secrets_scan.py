"""Secret scans with multipart credential linking, in DataFrame functions only.

Base kinds stand alone: an assignment of a value to a secret's name, an access
identifier, a long hex run.  Weak kinds are too common to report alone:

* ``blob``      40 to 64 characters of the base64 alphabet that mix upper case,
                lower case and digits: a candidate secret;
* ``endpoint``  a URL's scheme and host: a candidate end point.

A scope is one text, so the parts are linked inside the row.  The interval join
goes by blocks: the parts of a kind lie in order and do not overlap, so a block
of ``BLOCK`` of them is an interval; a weak part asks the blocks that its own
interval, widened by ``reach`` code points, meets, and then their parts.  No pairs
are made and nothing is shuffled.  A weak part is reported when a complement
lies within ``reach``: a blob beside an access identifier, an endpoint beside an
access identifier or an assignment.

Spans are ``kind:start:end`` in code points, end exclusive.

Defined results: a null or empty text has no spans; repeated rows are scanned
each; texts of any length are scanned whole; other columns are carried along
untouched, whatever their names; an empty table gives an empty
result; ties (same start) go by the order of kinds below.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"
BLOB = r"(?<![A-Za-z0-9+/])(?=[A-Za-z0-9+/]{0,63}[0-9])(?=[A-Za-z0-9+/]{0,63}[A-Z])(?=[A-Za-z0-9+/]{0,63}[a-z])[A-Za-z0-9+/]{40,64}(?![A-Za-z0-9+/])"
ENDPOINT = r"https?://[A-Za-z0-9.-]+(?::[0-9]{1,5})?"

KINDS = ("assign", "access", "hex", "blob", "endpoint")
REACH = 400
BLOCK = 64

_SPAN = "array<struct<start:int,rank:int,end:int>>"


def _spans(df: DataFrame, text: str, name: str, pattern: str, rank: int, keep) -> DataFrame:
    """Add column ``name`` with the spans of one kind.

    A match's end is a running sum.  ``aggregate`` would copy its array at each
    step, so the sums are taken over a sequence of the running total held in
    fixed-size blocks: positions inside a block, then the blocks' totals.
    """
    body = F.col(text)
    found = body.rlike(pattern)
    gaps = F.transform(F.split(body, pattern, -1), lambda x: F.char_length(x))
    hits = F.regexp_extract_all(body, F.lit(pattern), F.lit(0))
    df = df.withColumn("_gaps", F.when(found, gaps)).withColumn("_hits", F.when(found, hits))
    steps = F.zip_with(F.slice("_gaps", 1, F.size("_hits")), "_hits", lambda g, h: g + F.char_length(h))
    df = df.withColumn("_steps", F.when(F.col("_hits").isNotNull(), steps))
    size = 64
    n = F.size("_steps")
    blocks = F.transform(
        F.sequence(F.lit(0), F.floor((n - 1) / size).cast("int")),
        lambda b: F.aggregate(F.slice("_steps", b * size + 1, size), F.lit(0), lambda a, x: a + x),
    )
    df = df.withColumn("_blocks", F.when(n > 0, blocks))

    def end(i: Column) -> Column:
        b = F.floor(i / size).cast("int")
        before = F.when(b > 0, F.aggregate(F.slice("_blocks", 1, b), F.lit(0), lambda a, x: a + x)).otherwise(F.lit(0))
        return before + F.aggregate(F.slice("_steps", b * size + 1, i - b * size + 1), F.lit(0), lambda a, x: a + x)

    spans = F.transform(
        F.col("_hits"),
        lambda h, i: F.struct(
            (end(i) - F.char_length(h)).alias("start"), F.lit(rank).alias("rank"), end(i).alias("end"), h.alias("hit")
        ),
    )
    if keep is not None:
        spans = F.filter(spans, lambda s: keep(s["hit"]))
    spans = F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s["rank"].alias("rank"), s["end"].alias("end")))
    return df.withColumn(name, F.coalesce(F.when(n > 0, spans), F.array().cast(_SPAN))).drop("_gaps", "_hits", "_steps", "_blocks")


def _joined(spans: Column) -> Column:
    """``kind:start:end`` by start and then by kind, comma-joined."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(
        F.transform(
            F.array_sort(spans),
            lambda s: F.concat_ws(":", F.get(names, s["rank"]), s["start"].cast("string"), s["end"].cast("string")),
        ),
        ",",
    )


def scan(docs: DataFrame, text: str = "text", reach: int = REACH) -> DataFrame:
    """``docs`` with the spans of each row's whole text.

    Adds ``n_assign``, ``n_access``, ``n_hex``, ``base_spans``, ``spans``
    (strings) and ``n_weak``.  The text column itself is dropped: the caller
    joins or redacts by span.  Columns of ``docs`` with a name added here are replaced.
    """
    added = ("n_assign", "n_access", "n_hex", "n_weak", "spans", "base_spans", "_text", "_base", "_extra", "_assign", "_access", "_hex", "_blob", "_endpoint")
    found = _found(docs.drop(*[c for c in added if c != text]), text, reach)
    for kind in ("assign", "access", "hex"):
        found = found.withColumn(f"n_{kind}", F.size(f"_{kind}").cast("long"))
    return (
        found.withColumn("n_weak", F.size("_extra").cast("long"))
        .withColumn("spans", _joined(F.concat("_base", "_extra")))
        .withColumn("base_spans", _joined(F.col("_base")))
        .drop("_base", "_extra", "_assign", "_access", "_hex", "_blob", "_endpoint", "_text")
    )


def _found(docs: DataFrame, text: str, reach: int) -> DataFrame:
    """``docs`` with the spans of each kind, ``_base`` (all base ones) and ``_extra`` (the reported weak ones) in place of the text."""
    df = docs.withColumn("_text", F.coalesce(F.col(text).cast("string"), F.lit("")))
    if text != "_text":
        df = df.drop(text)
    long_value = lambda hit: F.char_length(F.regexp_extract(hit, ASSIGN, 2)) >= 6
    df = _spans(df, "_text", "_assign", ASSIGN, 0, long_value)
    df = _spans(df, "_text", "_access", ACCESS, 1, None)
    df = _spans(df, "_text", "_hex", HEX, 2, None)
    df = _spans(df, "_text", "_blob", BLOB, 3, None)
    df = _spans(df, "_text", "_endpoint", ENDPOINT, 4, None)
    df = df.withColumn("_base", F.concat("_assign", "_access", "_hex"))
    by_access, by_assign = _near("_access", reach), _near("_assign", reach)
    # A blob completes an access identifier; an endpoint completes either.
    blobs = F.filter("_blob", by_access)
    ends = F.filter("_endpoint", lambda w: by_access(w) | by_assign(w))
    strong = F.size("_access") + F.size("_assign") > 0
    return df.withColumn("_extra", F.when(strong, F.concat(blobs, ends)).otherwise(F.array().cast(_SPAN)))


def _near(kind: str, reach: int):
    """Whether a span lies within ``reach`` of one of the kind's spans."""
    n = F.size(kind)
    blocks = F.when(
        n > 0,
        F.transform(
            F.sequence(F.lit(0), F.floor((n - 1) / BLOCK).cast("int")),
            lambda b: F.struct(
                b.alias("b"),
                F.get(F.col(kind), b * BLOCK)["start"].alias("start"),
                F.get(F.col(kind), F.least(b * BLOCK + BLOCK, n) - 1)["end"].alias("end"),
            ),
        ),
    )
    meets = lambda x, w: (x["end"] >= w["start"] - reach) & (x["start"] <= w["end"] + reach)
    inside = lambda x, w: meets(x, w) & F.exists(F.slice(kind, x["b"] * BLOCK + 1, BLOCK), lambda s: meets(s, w))
    return lambda w: (n > 0) & F.exists(blocks, lambda x: inside(x, w))


def redact(docs: DataFrame, text: str = "text", reach: int = REACH, mark: str = "[secret]") -> DataFrame:
    """``docs`` with every span that ``scan`` reports (base and linked) replaced by ``mark``.

    Of an assignment the value goes.  Spans are those of the original text;
    overlapping ones give one mark.  Same columns as ``docs``; texts without a
    finding are unchanged, null stays null.
    """
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    body = F.col("_row")[text].cast("string")
    out = _found(docs.select(row.alias("_row"), F.col(text).cast("string").alias("_body")), "_body", reach)
    spans = F.concat("_base", "_extra")

    def cut(s: Column) -> Column:
        value = F.char_length(F.regexp_extract(body.substr(s["start"] + 1, s["end"] - s["start"]), ASSIGN, 2))
        return F.struct(F.when(s["rank"] == 0, s["end"] - value).otherwise(s["start"]).alias("start"), s["end"].alias("end"))

    out = out.withColumn("_cuts", F.when(F.size(spans) > 0, F.array_sort(F.transform(spans, cut))))
    ends = F.col("_cuts")["end"]
    size = 64
    blocks = F.transform(
        F.sequence(F.lit(0), F.floor((F.size("_cuts") - 1) / size).cast("int")),
        lambda b: F.array_max(F.slice(ends, b * size + 1, size)),
    )
    out = out.withColumn("_blocks", F.when(F.col("_cuts").isNotNull(), blocks))

    def piece(c: Column, i: Column) -> Column:
        """The text from the last end before a span, and the mark; nothing where it starts inside an earlier one."""
        b = F.floor(i / size).cast("int")
        before = F.greatest(F.array_max(F.slice("_blocks", 1, b)), F.array_max(F.slice(ends, b * size + 1, i - b * size)), F.lit(0))
        return F.when(c["start"] >= before, F.concat(body.substr(before + 1, c["start"] - before), F.lit(mark))).otherwise("")

    tail = body.substr(F.array_max(ends) + 1, F.char_length(body))
    clean = F.concat(F.array_join(F.transform("_cuts", piece), ""), tail)
    found = F.col("_cuts").isNotNull()
    columns = {c: F.col("_row")[c] for c in docs.columns}
    columns[text] = F.when(found, F.col("_clean")).otherwise(body)
    if "n_chars" in docs.columns:
        kind = docs.schema["n_chars"].dataType
        columns["n_chars"] = F.when(found, F.char_length("_clean").cast(kind)).otherwise(F.col("_row")["n_chars"])
    return out.withColumn("_clean", F.when(found, clean)).select(*[v.alias(c) for c, v in columns.items()])
