"""Columns that hold personal or confidential data: shapes with check digits, shapes inside longer text, names of columns.

All shapes of all text columns are counted in one aggregate; check digits are
worked out by Column expressions, only for cells of the right shape.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Shares of cells of a shape that make it high or medium, alone, by numbers that collide with others, or with a telling name; embedded ones; fixed values.
HIGH, COLLIDING, HINTED, MEDIUM = 0.6, 0.9, 0.3, 0.05
EMBEDDED_ROWS, EMBEDDED_SHARE = 3, 0.01
#: Classes from the most serious on; fixed values.
CLASSES = ("government_id", "financial", "health", "contact", "personal_name", "demographic", "location", "free_text")
CONFIDENCE = ("low", "medium", "high")
#: Words in a column's name by what they say; fixed values.
HINTS = {
    "phone": "phone mobile tel telephone fax cell msisdn", "email": "email mail emailaddress", "coordinate": "lat lon lng latitude longitude", "address": "address street suburb",
    "network": "ip ipv4 ipv6", "government": "ssn tfn abn acn medicare passport licence license nino", "financial": "salary income wage iban bsb account card balance",
    "health": "patient diagnosis medication condition icd", "demographic": "gender sex ethnicity race religion", "version": "version ver build release semver revision",
    "birth": "dob birth birthday birthdate dateofbirth", "code": "ticket code sku serial barcode isbn vin imei ref reference",
}
_HINTS = {k: frozenset(v.split()) for k, v in HINTS.items()}
#: Words before "name" that make it a person's, and whole words for one; an own list.
PERSON = frozenset("first last given sur full middle customer patient employee contact client person user student".split())
PERSON_NAMES = frozenset("firstname lastname surname fullname givenname middlename".split())
#: Weights of check sums; fixed values.
ABN_WEIGHTS, TFN_WEIGHTS, ACN_WEIGHTS = (10, 1, 3, 5, 7, 9, 11, 13, 15, 17, 19), (1, 4, 3, 7, 5, 8, 6, 9, 10), (8, 7, 6, 5, 4, 3, 2, 1)


def words(name: str) -> list[str]:
    """The words of a column's name in lower case, with the singular of each plural."""
    out = re.split(r"[^a-z0-9]+", re.sub(r"(?<=[a-z0-9])(?=[A-Z])", " ", name).lower())
    return [w for w in out if w] + [w[:-1] for w in out if len(w) > 3 and w.endswith("s") and not w.endswith("ss")]


def hint(name: str, group: str) -> str | None:
    return next((w for w in words(name) if w in _HINTS[group]), None)


# -- shapes -------------------------------------------------------------------


def _digits(c: Column) -> Column:
    return F.transform(F.split(F.regexp_replace(c, r"\D", ""), ""), lambda d: d.cast("int"))


def luhn(c: Column) -> Column:
    """Whether the digits of a text pass the check of card numbers."""
    back = F.reverse(_digits(c))
    double = F.transform(back, lambda d, i: F.when(i % 2 == 0, d).otherwise(F.when(d > 4, 2 * d - 9).otherwise(2 * d)))
    return F.aggregate(double, F.lit(0), lambda a, d: a + d) % 10 == 0


def iban(c: Column) -> Column:
    """Whether an account number passes the mod-97 check."""
    s = F.upper(F.regexp_replace(c, r"\s", ""))
    turned = F.split(F.concat(F.substring(s, 5, 40), F.substring(s, 1, 4)), "")
    number = lambda ch: F.when(ch.rlike(r"^\d$"), ch.cast("int")).otherwise(F.ascii(ch) - 55)
    rest = F.aggregate(F.transform(turned, number), F.lit(0), lambda a, n: F.when(n < 10, a * 10 + n).otherwise(a * 100 + n) % 97)
    return rest == 1


def weighted(c: Column, weights: tuple[int, ...], modulus: int, first_less: int = 0) -> Column:
    """Whether the digits' weighted sum is a multiple of the modulus."""
    d = F.transform(_digits(c), lambda x, i: F.when(i == 0, x - first_less).otherwise(x))
    return F.aggregate(F.zip_with(d, F.array(*[F.lit(w) for w in weights]), lambda x, w: x * w), F.lit(0), lambda a, x: a + x) % modulus == 0


def _acn(c: Column) -> Column:
    d = _digits(c)
    total = F.aggregate(F.zip_with(F.slice(d, 1, 8), F.array(*[F.lit(w) for w in ACN_WEIGHTS]), lambda x, w: x * w), F.lit(0), lambda a, x: a + x)
    return (10 - total % 10) % 10 == F.get(d, F.lit(8))


@dataclass(frozen=True)
class Shape:
    name: str
    kind: str
    noun: str
    pattern: str
    collides: bool
    hint: str | None
    check: object = None

    def test(self, s: Column) -> Column:
        fits = s.rlike(self.pattern)
        return F.when(fits, self.check(s)).otherwise(False) if self.check else fits


SHAPES = (
    Shape("email", "contact", "email addresses", r"^[\w.+-]+@[\w-]+(\.[\w-]+)+$", False, "email"),
    Shape("phone", "contact", "phone numbers", r"^(\+\d{1,3}[ -]?)?(\(\d{1,4}\)[ -]?)?\d{2,4}([ -]?\d{2,4}){1,4}$", True, "phone", lambda s: F.char_length(F.regexp_replace(s, r"\D", "")).between(8, 15)),
    Shape("card", "financial", "card numbers", r"^\d{4}[ -]?\d{4}[ -]?\d{4}[ -]?\d{1,7}$", True, "financial", luhn),
    Shape("iban", "financial", "IBANs", r"(?i)^[A-Z]{2}\d{2}[ ]?([A-Z0-9]{4}[ ]?){2,7}[A-Z0-9]{0,4}$", True, "financial", iban),
    Shape("tfn", "government_id", "tax file numbers", r"^\d{3}[ ]?\d{3}[ ]?\d{3}$", True, "government", lambda s: weighted(s, TFN_WEIGHTS, 11)),
    Shape("abn", "government_id", "business numbers", r"^\d{2}[ ]?\d{3}[ ]?\d{3}[ ]?\d{3}$", True, "government", lambda s: weighted(s, ABN_WEIGHTS, 89, 1)),
    Shape("acn", "government_id", "company numbers", r"^\d{3}[ ]?\d{3}[ ]?\d{3}$", True, "government", _acn),
    Shape("ssn", "government_id", "national id numbers", r"^(?!000|666|9\d\d)\d{3}-(?!00)\d{2}-(?!0000)\d{4}$", True, "government"),
    Shape("ip", "location", "IP addresses", r"^(25[0-5]|2[0-4]\d|1?\d?\d)(\.(25[0-5]|2[0-4]\d|1?\d?\d)){3}$", False, "network"),
    Shape("lat/lon", "location", "coordinate pairs", r"^-?\d{1,2}\.\d+\s*,\s*-?\d{1,3}\.\d+$", False, "coordinate"),
)
#: Shapes inside longer text.
INSIDE = {
    "email": (r"[\w.+-]+@[\w-]+\.[\w.-]+", None),
    "phone": (r"(?<!\d)(\+\d{1,3}[ -]?)?(\(\d{2,4}\)|\d{3,4})[ -]\d{3,4}[ -]\d{3,4}(?!\d)", None),
    "card": (r"(?<!\d)\d{4}[ -]?\d{4}[ -]?\d{4}[ -]?\d{1,7}(?!\d)", luhn),
}


def counts(df: DataFrame, columns: list[str]) -> list[dict]:
    """For each column its filled cells, cells of each shape, and longer cells with a shape inside; one aggregate."""
    aggs = []
    for i, c in enumerate(columns):
        s = F.trim(F.col(f"`{c}`").cast("string"))
        s = F.when(s != "", s)
        aggs.append(F.count(s).alias(f"n{i}"))
        aggs += [F.count_if(x.test(s)).alias(f"{x.name}{i}") for x in SHAPES]
        long_text = s.rlike(r"\s\S+\s")
        for name, (pattern, check) in INSIDE.items():
            hit = s.rlike(pattern)
            if check:
                hit = F.exists(F.regexp_extract_all(s, F.lit(pattern), F.lit(0)), check)
            aggs.append(F.count_if(F.when(long_text, hit).otherwise(False)).alias(f"in_{name}{i}"))
    one = df.agg(*aggs).first()
    return [{"column": c, "cells": one[f"n{i}"]} | {x.name: one[f"{x.name}{i}"] for x in SHAPES} | {f"in_{k}": one[f"in_{k}{i}"] for k in INSIDE} for i, c in enumerate(columns)]


def signals(found: dict) -> list[tuple[str, str, str, float]]:
    """(class, confidence, reason, share) of one column."""
    name, cells = found["column"], found["cells"]
    out: list[tuple[str, str, str, float]] = []
    code = hint(name, "code") is not None
    for x in SHAPES:
        n = found[x.name]
        if not n or x.name == "ip" and hint(name, "version"):
            continue
        share = n / cells
        told = x.hint is not None and hint(name, x.hint) is not None
        if code and x.collides and not told:
            continue
        alone = share >= COLLIDING or share >= HIGH and told if x.collides else share >= HIGH
        level = "high" if alone or told and share >= HINTED else "medium" if told and share >= MEDIUM else None
        if level:
            out.append((x.kind, level, f"{share:.0%} of values look like {x.noun}", share))
    inside = {k: found[f"in_{k}"] for k in INSIDE if found[f"in_{k}"] >= EMBEDDED_ROWS and found[f"in_{k}"] >= EMBEDDED_SHARE * cells}
    if inside:
        out.append(("free_text", "high" if "card" in inside else "medium", f"some texts contain: {', '.join(inside)}", min(1.0, sum(inside.values()) / cells)))
    by_name = []
    if hint(name, "birth"):
        by_name.append(("demographic", "medium"))
    government, financial, health = hint(name, "government"), hint(name, "financial"), hint(name, "health")
    if government:
        by_name.append(("government_id", "low" if government in ("abn", "acn") else "medium"))
    if financial:
        number = financial == "card" and set(words(name)) & {"number", "no", "num", "digits", "pan"}
        by_name.append(("financial", "medium" if financial in ("iban", "bsb") or number else "low"))
    if health and health != "patient":
        by_name.append(("health", "medium" if health in ("diagnosis", "icd") else "low"))
    for group, kind, level in (("phone", "contact", "medium"), ("email", "contact", "medium"), ("address", "location", "low"), ("coordinate", "location", "low"), ("network", "location", "low"), ("demographic", "demographic", "low")):
        if hint(name, group):
            by_name.append((kind, level))
    own = words(name)
    if set(own) & PERSON_NAMES or "name" in own and set(own) & PERSON:
        by_name.append(("personal_name", "medium"))
    return out + [(kind, level, "the column's name", 0.0) for kind, level in by_name]


def label(kind: str, level: str) -> str:
    """How a finding is to be handled."""
    if kind in ("government_id", "health"):
        return "confidential" if level == "low" else "restricted"
    return "internal" if level == "low" else "confidential"


def scan(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """One row for each column with a finding: class, confidence, label, reason, share; the strongest signal decides."""
    columns = columns or [c for c, t in df.dtypes if t == "string" or any(hint(c, g) for g in ("phone", "financial", "government"))]
    rows = []
    for found in counts(df, columns) if columns else []:
        best = max(signals(found), key=lambda s: (CONFIDENCE.index(s[1]), -CLASSES.index(s[0])), default=None)
        if best:
            rows.append((found["column"], best[0], best[1], label(best[0], best[1]), best[2], best[3]))
    return df.sparkSession.createDataFrame(rows, "column string, class string, confidence string, label string, reason string, share double")
