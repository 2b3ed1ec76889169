"""Text normalising and similarity: Columns where built-ins reach, Arrow UDFs on distinct values elsewhere."""

from __future__ import annotations

import re
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

#: Letters that decompose to a base letter; fixed values.
_MARKED = "áàâäãåçéèêëíìîïñóòôöõúùûüýÿ"
_PLAIN = "aaaaaaceeeeiiiinooooouuuuyy"


def normalize(c: Column) -> Column:
    """Lower case, Latin-1 marks off, apostrophes off, ø đ ð ł folded, white space collapsed; null is the empty text."""
    out = F.lower(F.coalesce(c.cast("string"), F.lit("")))
    out = F.translate(out, _MARKED + "øđðł", _PLAIN + "oddl")
    for a, b in (("æ", "ae"), ("œ", "oe"), ("ß", "ss"), ("þ", "th")):
        out = F.replace(out, F.lit(a), F.lit(b))
    out = F.regexp_replace(out, "['’‘`]", "")
    return F.trim(F.regexp_replace(out, r"\s+", " "))


def normalize_full(text: str | None) -> str:
    """The same for any script: marks of Latin, Greek and Cyrillic letters go."""
    out = []
    for ch in unicodedata.normalize("NFD", (text or "").lower()):
        if unicodedata.combining(ch):
            base = next((c for c in reversed(out) if not unicodedata.combining(c)), "")
            if base and unicodedata.name(base, "").startswith(("LATIN", "GREEK", "CYRILLIC")):
                continue
        out.append(ch)
    s = unicodedata.normalize("NFC", "".join(out))
    for a, b in (("ø", "o"), ("đ", "d"), ("ð", "d"), ("ł", "l"), ("æ", "ae"), ("œ", "oe"), ("ß", "ss"), ("þ", "th"), ("'", ""), ("’", ""), ("‘", ""), ("`", "")):
        s = s.replace(a, b)
    return " ".join(s.split())


def jaro_winkler(a: str, b: str) -> float:
    """Jaro similarity raised by the common beginning (0.1 for each of at most 4 letters), at any similarity."""
    if a == b:
        return 1.0
    la, lb = len(a), len(b)
    if not la or not lb:
        return 0.0
    reach = max(0, max(la, lb) // 2 - 1)
    used = [False] * lb
    matched_a = []
    for i, ch in enumerate(a):
        for j in range(max(0, i - reach), min(lb, i + reach + 1)):
            if not used[j] and b[j] == ch:
                used[j] = True
                matched_a.append(ch)
                break
    m = len(matched_a)
    if not m:
        return 0.0
    matched_b = [b[j] for j in range(lb) if used[j]]
    swaps = sum(x != y for x, y in zip(matched_a, matched_b, strict=True)) / 2
    jaro = (m / la + m / lb + (m - swaps) / m) / 3
    prefix = 0
    for x, y in zip(a[:4], b[:4], strict=False):
        if x != y:
            break
        prefix += 1
    return jaro + prefix * 0.1 * (1 - jaro)


@F.pandas_udf(DoubleType())
def jaro_winkler_udf(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([jaro_winkler(x or "", y or "") for x, y in zip(a, b, strict=True)])


def query_words(query: str | None) -> list[str]:
    """The words of a query, as ``tokens`` splits a cell."""
    return re.findall(r"[^\W_]+", normalize_full(query))


def tokens(c: Column) -> Column:
    """The words of a normalised text."""
    return F.filter(F.split(F.regexp_replace(normalize(c), r"[^\p{L}\p{N}]+", " "), " "), lambda x: x != "")
