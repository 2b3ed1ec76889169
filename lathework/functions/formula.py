"""The formula language: spreadsheet-like formulas compiled to Columns.

``[column]`` names a column.  Precedence from low to high: comparison, ``&``,
``+ -``, ``* /``, ``^`` (right), unary minus.  A blank in arithmetic gives a
blank; a comparison with a blank is FALSE, but ``<>`` is TRUE; texts compare
without case; AND and OR take a blank as FALSE; dates differ in days.  An error
is a value: each node compiles to a value and an error flag, an error blanks the
cell, IFERROR catches it.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

_LEX = re.compile(r"\s*(?:(\d+(?:\.\d+)?(?:[eE][+-]?\d+)?)|\"((?:[^\"]|\"\")*)\"|\[([^\]]+)\]|([A-Za-z_][A-Za-z_0-9.]*)|(<>|<=|>=|[-+*/^&=<>(),;]))")


class FormulaError(ValueError):
    """The formula cannot be read or its types do not fit."""


@dataclass
class V:
    """A compiled node: value, error flag (None: never) and type num, text, bool, date or any."""

    c: Column
    e: Column | None
    t: str


def _tokens(text: str) -> list[tuple[str, str]]:
    out, at = [], 0
    text = text.strip()
    if text.startswith("="):
        text = text[1:]
    while text[at:].strip():
        m = _LEX.match(text, at)
        if not m:
            raise FormulaError(f"cannot read {text[at:at + 20]!r}")
        at = m.end()
        for kind, g in zip(("num", "text", "column", "name", "op"), m.groups(), strict=True):
            if g is not None:
                out.append((kind, g.replace('""', '"') if kind == "text" else g))
                break
    return out


_PARTS = re.compile(r"\"(?:[^\"]|\"\")*\"|\[((?:[^\]]|\]\])+)\]")


def rename(text: str, names: dict[str, str]) -> str:
    """A formula with the columns it names renamed; quoted texts stay."""
    new = {k.strip().lower(): v for k, v in names.items()}

    def one(m: re.Match) -> str:
        own = m[1]
        to = None if own is None else new.get(own.replace("]]", "]").strip().lower())
        return m[0] if to is None else f"[{to.replace(']', ']]')}]"

    return _PARTS.sub(one, text)


class _Parser:
    def __init__(self, text: str):
        self.tokens, self.at = _tokens(text), 0

    def peek(self) -> tuple[str, str]:
        return self.tokens[self.at] if self.at < len(self.tokens) else ("end", "")

    def take(self, *ops: str) -> str | None:
        kind, value = self.peek()
        if kind == "op" and value in ops:
            self.at += 1
            return value
        return None

    def parse(self):
        out = self.compare()
        if self.peek()[0] != "end":
            raise FormulaError(f"unexpected {self.peek()[1]!r}")
        return out

    def _left(self, ops, below):
        out = below()
        while op := self.take(*ops):
            out = ("op", op, out, below())
        return out

    def compare(self):
        return self._left(("=", "<>", "<", "<=", ">", ">="), self.join)

    def join(self):
        return self._left(("&",), self.sum)

    def sum(self):
        return self._left(("+", "-"), self.product)

    def product(self):
        return self._left(("*", "/"), self.power)

    def power(self):
        out = self.unary()
        if self.take("^"):
            return ("op", "^", out, self.power())
        return out

    def unary(self):
        if self.take("-"):
            return ("neg", self.unary())
        if self.take("+"):
            return self.unary()
        return self.atom()

    def atom(self):
        kind, value = self.peek()
        self.at += 1
        if kind in ("num", "text", "column"):
            return (kind, value)
        if kind == "name":
            upper = value.upper()
            if upper in ("TRUE", "FALSE") and not (self.peek() == ("op", "(")):
                return ("bool", upper == "TRUE")
            if not self.take("("):
                return ("column", value)
            args = []
            if not self.take(")"):
                args.append(self.compare())
                while self.take(",", ";"):
                    args.append(self.compare())
                if not self.take(")"):
                    raise FormulaError("missing )")
            if upper in ("TRUE", "FALSE") and not args:
                return ("bool", upper == "TRUE")
            return ("call", upper, args)
        if kind == "op" and value == "(":
            out = self.compare()
            if not self.take(")"):
                raise FormulaError("missing )")
            return out
        raise FormulaError(f"unexpected {value!r}" if value else "formula ends early")


def parse(text: str):
    """The syntax tree of a formula."""
    return _Parser(text).parse()




def _or(*es: Column | None) -> Column | None:
    out = None
    for e in es:
        if e is not None:
            out = e if out is None else out | e
    return out


class Compiler:
    """Compiles formulas against a table's columns.

    ``order``: the row order of RUNNINGSUM, PREVIOUS, ROWNUMBER and RANK ties;
    ``by``: optional partition of whole-column functions; ``now``: TODAY and NOW.
    """

    def __init__(self, df: DataFrame, order: str | None = None, now: str = "2024-01-01 00:00:00", by: tuple[str, ...] = ()):
        self.types = {f.name: self._type(f.dataType.simpleString()) for f in df.schema}
        self.names = {f.name.lower(): f.name for f in df.schema}
        self.order, self.now, self.by = order, now, by

    @staticmethod
    def _type(t: str) -> str:
        if t in ("tinyint", "smallint", "int", "bigint", "float", "double") or t.startswith("decimal"):
            return "num"
        return {"boolean": "bool", "date": "date"}.get(t, "date" if t.startswith("timestamp") else "text")

    def compile(self, text: str) -> V:
        return self.node(parse(text))

    def column(self, text: str) -> Column:
        """The formula's value; an error is null."""
        v = self.compile(text)
        return v.c if v.e is None else F.when(~F.coalesce(v.e, F.lit(False)), v.c)

    def error(self, text: str) -> Column:
        """Whether the formula fails in a row."""
        v = self.compile(text)
        return F.lit(False) if v.e is None else F.coalesce(v.e, F.lit(False))

    # -- nodes ---------------------------------------------------------------

    def node(self, n) -> V:
        kind = n[0]
        if kind == "num":
            return V(F.lit(float(n[1])), None, "num")
        if kind == "text":
            return V(F.lit(n[1] or None).cast("string"), None, "text")
        if kind == "bool":
            return V(F.lit(n[1]), None, "bool")
        if kind == "column":
            name = self.names.get(n[1].strip().lower())
            if name is None:
                raise FormulaError(f"no column {n[1]!r}")
            c, t = F.col(f"`{name}`"), self.types[name]
            if t == "num":
                c = c.cast("double")
                c = F.when(~F.isnan(c), c)
            elif t == "text":
                c = F.when(c != "", c)
            return V(c, None, t)
        if kind == "neg":
            a = self.num(n[1])
            return V(-a.c, a.e, "num")
        if kind == "op":
            return self.binary(n[1], self.node(n[2]), self.node(n[3]))
        return self.call(n[1], n[2])

    def num(self, n) -> V:
        v = n if isinstance(n, V) else self.node(n)
        if v.t == "num":
            return v
        if v.t == "bool":
            return V(v.c.cast("int").cast("double"), v.e, "num")
        if v.t == "date":
            return v
        if v.t == "any":
            return V(F.lit(None).cast("double"), v.e, "num")
        raise FormulaError("a number is needed")

    def text(self, n) -> V:
        v = n if isinstance(n, V) else self.node(n)
        if v.t == "text":
            return v
        if v.t == "num":
            whole = v.c == F.floor(v.c)
            return V(F.when(whole & (F.abs(v.c) < 1e15), v.c.cast("bigint").cast("string")).otherwise(F.regexp_replace(F.format_string("%.15g", v.c), r"(\.\d*?)0+$", "$1")), v.e, "text")
        if v.t == "bool":
            return V(F.when(v.c, "TRUE").when(~v.c, "FALSE"), v.e, "text")
        if v.t == "any":
            return V(F.lit(None).cast("string"), v.e, "text")
        return V(F.regexp_replace(F.date_format(v.c, "yyyy-MM-dd HH:mm:ss"), " 00:00:00$", ""), v.e, "text")

    def truth(self, n) -> V:
        v = n if isinstance(n, V) else self.node(n)
        if v.t == "bool":
            return V(F.coalesce(v.c, F.lit(False)), v.e, "bool")
        if v.t == "num":
            return V(F.coalesce(v.c != 0, F.lit(False)), v.e, "bool")
        raise FormulaError("a condition is needed")

    def binary(self, op: str, a: V, b: V) -> V:
        e = _or(a.e, b.e)
        if op == "&":
            x, y = self.text(a), self.text(b)
            return V(F.concat(F.coalesce(x.c, F.lit("")), F.coalesce(y.c, F.lit(""))), e, "text")
        if op in ("=", "<>", "<", "<=", ">", ">="):
            return V(self._compare(op, a, b), e, "bool")
        if op in ("+", "-") and "date" in (a.t, b.t):
            if a.t == b.t == "date":
                if op == "+":
                    raise FormulaError("two dates cannot be added")
                return V((F.unix_seconds(a.c.cast("timestamp")) - F.unix_seconds(b.c.cast("timestamp"))) / 86400.0, e, "num")
            d, n = (a, self.num(b)) if a.t == "date" else (b, self.num(a))
            days = F.floor(n.c).cast("int")
            return V(F.date_add(d.c.cast("date"), days if op == "+" else -days), e, "date")
        x, y = self.num(a), self.num(b)
        if op == "+":
            return V(x.c + y.c, e, "num")
        if op == "-":
            return V(x.c - y.c, e, "num")
        if op == "*":
            return V(x.c * y.c, e, "num")
        if op == "/":
            zero = x.c.isNotNull() & y.c.isNotNull() & (y.c == 0)
            return V(F.try_divide(x.c, y.c), _or(e, zero), "num")
        return self._finite(F.pow(x.c, y.c), e)

    @staticmethod
    def _finite(c: Column, e: Column | None) -> V:
        bad = F.coalesce(F.isnan(c) | (F.abs(c) == float("inf")), F.lit(False))
        return V(F.when(~bad, c), _or(e, bad), "num")

    def _compare(self, op: str, a: V, b: V) -> Column:
        if a.t == "text" or b.t == "text":
            x, y = F.lower(self.text(a).c), F.lower(self.text(b).c)
        elif "date" in (a.t, b.t):
            x, y = a.c.cast("timestamp_ntz"), b.c.cast("timestamp_ntz")
        else:
            x, y = self.num(a).c, self.num(b).c
        out = {"=": x == y, "<>": x != y, "<": x < y, "<=": x <= y, ">": x > y, ">=": x >= y}[op]
        if op == "<>":
            # A blank has no value that could be equal.
            return F.coalesce(out, F.lit(True))
        return F.coalesce(out, F.lit(False))

    def same(self, vs: list[V]) -> tuple[list[Column], str]:
        """Branches of one type; mixed ones become text."""
        kinds = {v.t for v in vs if v.t != "any"}
        t = kinds.pop() if len(kinds) == 1 else "text" if kinds else "text"
        cast = {"num": "double", "text": "string", "bool": "boolean", "date": None}[t]
        return [self.text(v).c if t == "text" else v.c if cast is None else v.c.cast(cast) for v in vs], t

    def _pick(self, conds: list[V], values: list[V], other: V | None) -> V:
        cols, t = self.same(values + ([other] if other else []))
        out, err = None, None
        for i, (c, v) in enumerate(zip(conds, values, strict=True)):
            out = F.when(c.c, cols[i]) if out is None else out.when(c.c, cols[i])
            mine = _or(c.e, None)
            flag = F.coalesce(v.e, F.lit(False)) if v.e is not None else F.lit(False)
            err = F.when(c.c, flag) if err is None else err.when(c.c, flag)
            if mine is not None:
                err = F.when(F.coalesce(mine, F.lit(False)), True).otherwise(err)
        if other is None:
            return V(out, F.coalesce(err, F.lit(True)), t)
        last = F.coalesce(other.e, F.lit(False)) if other.e is not None else F.lit(False)
        return V(out.otherwise(cols[-1]), F.coalesce(err, last), t)

    def call(self, name: str, args: list) -> V:
        method = getattr(self, f"f_{name.lower()}", None)
        if method is None:
            raise FormulaError(f"unknown function {name}")
        try:
            return method(*args)
        except TypeError as bad:
            raise FormulaError(f"{name}: wrong number of arguments") from bad

    # -- logic ---------------------------------------------------------------

    def f_if(self, cond, yes, no=None) -> V:
        return self._pick([self.truth(cond)], [self.node(yes)], self.node(no) if no else V(F.lit(None), None, "any"))

    def f_and(self, *args) -> V:
        vs = [self.truth(a) for a in args]
        out = vs[0].c
        for v in vs[1:]:
            out = out & v.c
        return V(out, _or(*[v.e for v in vs]), "bool")

    def f_or(self, *args) -> V:
        vs = [self.truth(a) for a in args]
        out = vs[0].c
        for v in vs[1:]:
            out = out | v.c
        return V(out, _or(*[v.e for v in vs]), "bool")

    def f_not(self, a) -> V:
        v = self.truth(a)
        return V(~v.c, v.e, "bool")

    def f_ifs(self, *args) -> V:
        if len(args) % 2:
            raise FormulaError("IFS needs pairs")
        return self._pick([self.truth(a) for a in args[::2]], [self.node(a) for a in args[1::2]], None)

    def f_switch(self, x, *args) -> V:
        v = self.node(x)
        other = self.node(args[-1]) if len(args) % 2 else None
        pairs = args[:-1] if len(args) % 2 else args
        conds = [V(self._compare("=", v, self.node(a)), v.e, "bool") for a in pairs[::2]]
        return self._pick(conds, [self.node(a) for a in pairs[1::2]], other)

    def f_iferror(self, a, b) -> V:
        v, w = self.node(a), self.node(b)
        if v.e is None:
            return v
        cols, t = self.same([v, w])
        bad = F.coalesce(v.e, F.lit(False))
        return V(F.when(bad, cols[1]).otherwise(cols[0]), None if w.e is None else bad & w.e, t)

    def f_isblank(self, a) -> V:
        v = self.node(a)
        return V(v.c.isNull(), v.e, "bool")

    def f_isnumber(self, a) -> V:
        v = self.node(a)
        return V(v.c.isNotNull() if v.t == "num" else F.lit(False), v.e, "bool")

    def f_istext(self, a) -> V:
        v = self.node(a)
        return V(v.c.isNotNull() if v.t == "text" else F.lit(False), v.e, "bool")

    def f_coalesce(self, *args) -> V:
        vs = [self.node(a) for a in args]
        cols, t = self.same(vs)
        return V(F.coalesce(*cols), _or(*[v.e for v in vs]), t)

    f_ifblank = f_coalesce

    # -- math ----------------------------------------------------------------

    def _n(self, *args) -> tuple[list[Column], Column | None]:
        vs = [self.num(a) for a in args]
        return [v.c for v in vs], _or(*[v.e for v in vs])

    def f_round(self, x, d=("num", "0")) -> V:
        (a, b), e = self._n(x, d)
        f = F.pow(F.lit(10.0), b)
        y = F.abs(a) * f
        return V(F.signum(a) * F.floor(y + 0.5 + 1e-9) / f, e, "num")

    def f_abs(self, x) -> V:
        (a,), e = self._n(x)
        return V(F.abs(a), e, "num")

    def f_min(self, *args) -> V:
        cs, e = self._n(*args)
        return V(F.least(*cs) if len(cs) > 1 else cs[0], e, "num")

    def f_max(self, *args) -> V:
        cs, e = self._n(*args)
        return V(F.greatest(*cs) if len(cs) > 1 else cs[0], e, "num")

    def f_sum(self, *args) -> V:
        cs, e = self._n(*args)
        out = F.lit(0.0)
        for c in cs:
            out = out + F.coalesce(c, F.lit(0.0))
        return V(out, e, "num")

    def f_average(self, *args) -> V:
        cs, e = self._n(*args)
        n, s = F.lit(0), F.lit(0.0)
        for c in cs:
            n, s = n + c.isNotNull().cast("int"), s + F.coalesce(c, F.lit(0.0))
        return V(F.try_divide(s, n), _or(e, n == 0), "num")

    def f_int(self, x) -> V:
        (a,), e = self._n(x)
        return V(F.floor(a + 1e-9).cast("double"), e, "num")

    def f_trunc(self, x, d=("num", "0")) -> V:
        (a, b), e = self._n(x, d)
        f = F.pow(F.lit(10.0), b)
        return V(F.signum(a) * F.floor(F.abs(a) * f + 1e-9) / f, e, "num")

    f_rounddown = f_trunc

    def f_roundup(self, x, d=("num", "0")) -> V:
        (a, b), e = self._n(x, d)
        f = F.pow(F.lit(10.0), b)
        return V(F.signum(a) * F.ceil(F.abs(a) * f - 1e-9) / f, e, "num")

    def f_mod(self, x, y) -> V:
        (a, b), e = self._n(x, y)
        return V(a - b * F.floor(F.try_divide(a, b)), _or(e, F.coalesce(b == 0, F.lit(False))), "num")

    def f_sqrt(self, x) -> V:
        (a,), e = self._n(x)
        return V(F.when(a >= 0, F.sqrt(a)), _or(e, F.coalesce(a < 0, F.lit(False))), "num")

    def f_power(self, x, y) -> V:
        return self.binary("^", self.node(x), self.node(y))

    def f_ln(self, x) -> V:
        (a,), e = self._n(x)
        return V(F.when(a > 0, F.log(a)), _or(e, F.coalesce(a <= 0, F.lit(False))), "num")

    def _multiple(self, x, m, how, eps) -> V:
        (a, b), e = self._n(x, m)
        wrong = F.coalesce((a > 0) & (b < 0), F.lit(False))
        return V(F.when(b == 0, F.lit(0.0)).otherwise(how(F.try_divide(a, b) + eps) * b), _or(e, wrong), "num")

    def f_ceiling(self, x, m=("num", "1")) -> V:
        return self._multiple(x, m, F.ceil, -1e-9)

    def f_floor(self, x, m=("num", "1")) -> V:
        return self._multiple(x, m, F.floor, 1e-9)

    # -- text ----------------------------------------------------------------

    def _t(self, *args) -> tuple[list[Column], Column | None]:
        vs = [self.text(a) for a in args]
        return [v.c for v in vs], _or(*[v.e for v in vs])

    @staticmethod
    def _or_empty(c: Column) -> Column:
        return F.coalesce(c, F.lit(""))

    @staticmethod
    def _blank(c: Column) -> Column:
        return F.when(c != "", c)

    def f_len(self, x) -> V:
        (a,), e = self._t(x)
        return V(F.char_length(self._or_empty(a)).cast("double"), e, "num")

    def _with_n(self, x, n) -> tuple[Column, Column, Column | None]:
        a, b = self.text(x), self.num(n)
        return self._or_empty(a.c), F.floor(b.c).cast("int"), _or(a.e, b.e)

    def f_left(self, x, n=("num", "1")) -> V:
        a, k, e = self._with_n(x, n)
        return V(self._blank(F.substring(a, F.lit(1), F.greatest(k, F.lit(0)))), _or(e, k < 0), "text")

    def f_right(self, x, n=("num", "1")) -> V:
        a, k, e = self._with_n(x, n)
        return V(self._blank(F.right(a, F.greatest(k, F.lit(0)))), _or(e, k < 0), "text")

    def f_mid(self, x, start, n) -> V:
        a, s, e = self._with_n(x, start)
        k = self.num(n)
        count = F.floor(k.c).cast("int")
        return V(self._blank(F.substring(a, F.greatest(s, F.lit(1)), F.greatest(count, F.lit(0)))), _or(e, k.e, (s < 1) | (count < 0)), "text")

    def _find(self, needle, hay, start, fold) -> V:
        (a, b), e = self._t(needle, hay)
        s = self.num(start)
        a, b = self._or_empty(a), self._or_empty(b)
        if fold:
            a, b = F.lower(a), F.lower(b)
        at = F.call_function("locate", a, b, F.floor(s.c).cast("int"))
        return V(F.when(at > 0, at.cast("double")), _or(e, s.e, at == 0), "num")

    def f_find(self, needle, hay, start=("num", "1")) -> V:
        return self._find(needle, hay, start, False)

    def f_search(self, needle, hay, start=("num", "1")) -> V:
        return self._find(needle, hay, start, True)

    def f_upper(self, x) -> V:
        (a,), e = self._t(x)
        return V(F.upper(a), e, "text")

    def f_lower(self, x) -> V:
        (a,), e = self._t(x)
        return V(F.lower(a), e, "text")

    def f_trim(self, x) -> V:
        (a,), e = self._t(x)
        return V(self._blank(F.trim(F.regexp_replace(a, " +", " "))), e, "text")

    def f_concat(self, *args) -> V:
        cs, e = self._t(*args)
        return V(F.concat(*[self._or_empty(c) for c in cs]), e, "text")

    f_concatenate = f_concat

    def f_contains(self, x, y) -> V:
        (a, b), e = self._t(x, y)
        return V(F.contains(F.lower(self._or_empty(a)), F.lower(self._or_empty(b))), e, "bool")

    def f_substitute(self, x, old, new, nth=None) -> V:
        (a, b, c), e = self._t(x, old, new)
        a, b, c = self._or_empty(a), self._or_empty(b), self._or_empty(c)
        if nth is None:
            return V(self._blank(F.when(b == "", a).otherwise(F.replace(a, b, c))), e, "text")
        k = self.num(nth)
        n = F.floor(k.c).cast("int")
        parts = F.split(a, F.concat(F.lit("\\Q"), b, F.lit("\\E")), F.lit(-1))
        head = F.array_join(F.slice(parts, F.lit(1), n), "\u0001")
        joined = F.concat(F.replace(head, F.lit("\u0001"), b), c, F.replace(F.array_join(F.slice(parts, n + 1, F.greatest(F.size(parts) - n, F.lit(0))), "\u0001"), F.lit("\u0001"), b))
        return V(self._blank(F.when((b != "") & (F.size(parts) > n), joined).otherwise(a)), _or(e, k.e, n < 1), "text")

    def f_replace(self, x, start, n, new) -> V:
        a, s, e = self._with_n(x, start)
        k, t = self.num(n), self.text(new)
        return V(self._blank(F.overlay(a, self._or_empty(t.c), s, F.floor(k.c).cast("int"))), _or(e, k.e, t.e, s < 1), "text")

    def f_proper(self, x) -> V:
        (a,), e = self._t(x)
        # A letter after anything but a letter starts a word.
        words = F.regexp_extract_all(F.lower(a), F.lit(r"(\p{L}+|\P{L}+)"), F.lit(1))
        return V(F.array_join(F.transform(words, lambda w: F.concat(F.upper(F.substring(w, 1, 1)), F.substring(w, 2, 1_000_000))), ""), e, "text")

    def f_exact(self, x, y) -> V:
        (a, b), e = self._t(x, y)
        return V(self._or_empty(a) == self._or_empty(b), e, "bool")

    def _around(self, x, mark, nth, before: bool) -> V:
        (a, b), e = self._t(x, mark)
        k = self.num(nth)
        a, b, n = self._or_empty(a), self._or_empty(b), F.floor(k.c).cast("int")
        parts = F.split(a, F.concat(F.lit("\\Q"), b, F.lit("\\E")), F.lit(-1))
        count = F.size(parts) - 1
        at = F.when(n < 0, count + 1 + n).otherwise(n)
        absent = (b == "") | (at < 1) | (at > count)
        safe = F.greatest(F.least(at, count), F.lit(1))
        piece = F.slice(parts, F.lit(1), safe) if before else F.slice(parts, safe + 1, F.greatest(F.size(parts) - safe, F.lit(0)))
        out = F.aggregate(piece, F.struct(F.lit("").alias("s"), F.lit(True).alias("first")), lambda acc, p: F.struct(F.concat(acc["s"], F.when(acc["first"], F.lit("")).otherwise(b), p).alias("s"), F.lit(False).alias("first")))["s"]
        return V(self._blank(F.when(~absent, out)), _or(e, k.e, absent), "text")

    def f_textbefore(self, x, mark, nth=("num", "1")) -> V:
        return self._around(x, mark, nth, True)

    def f_textafter(self, x, mark, nth=("num", "1")) -> V:
        return self._around(x, mark, nth, False)

    def f_textjoin(self, mark, skip, *args) -> V:
        (m, *cs), e = self._t(mark, *args)
        s = self.truth(skip)
        every = F.array(*[self._or_empty(c) for c in cs])
        kept = F.when(s.c, F.filter(every, lambda x: x != "")).otherwise(every)
        return V(self._blank(F.replace(F.array_join(kept, "\u0001"), F.lit("\u0001"), self._or_empty(m))), _or(e, s.e), "text")

    def f_text(self, x, form) -> V:
        v = self.node(x)
        if form[0] != "text":
            raise FormulaError("TEXT needs a literal format")
        fmt = form[1]
        if v.t == "date":
            java = fmt
            for a, b in (("YYYY", "yyyy"), ("yyyy", "yyyy"), ("DD", "dd"), ("mmmm", "MMMM"), ("mmm", "MMM"), ("hh", "HH")):
                java = java.replace(a, b)
            java = re.sub(r"(?<![Hh:])mm(?!:)", "MM", java)
            return V(F.date_format(v.c, java), v.e, "text")
        n = self.num(v)
        decimals = len(fmt.partition(".")[2].rstrip("%")) if "." in fmt else 0
        c = n.c * 100 if fmt.endswith("%") else n.c
        out = F.format_number(F.round(c, decimals), decimals)
        if "," not in fmt:
            out = F.replace(out, F.lit(","), F.lit(""))
        if set(fmt) == {"0"} and len(fmt) > 1:
            out = F.lpad(out, len(fmt), "0")
        return V(F.concat(out, F.lit("%")) if fmt.endswith("%") else out, n.e, "text")

    def f_value(self, x) -> V:
        v = self.node(x)
        if v.t == "num":
            return v
        t = self.text(v)
        clean = F.regexp_replace(F.trim(t.c), r"[$€£¥,\s]", "")
        n = F.when(clean.endswith("%"), F.try_divide(F.regexp_replace(clean, "%$", "").try_cast("double"), F.lit(100.0))).otherwise(clean.try_cast("double"))
        return V(n, _or(t.e, t.c.isNotNull() & n.isNull()), "num")

    # -- dates ---------------------------------------------------------------

    def _d(self, x) -> V:
        v = self.node(x)
        if v.t == "date":
            return v
        if v.t == "text":
            c = v.c.try_cast("timestamp_ntz")
            return V(c, _or(v.e, v.c.isNotNull() & c.isNull()), "date")
        raise FormulaError("a date is needed")

    def _field(self, x, how) -> V:
        v = self._d(x)
        return V(how(v.c).cast("double"), v.e, "num")

    def f_year(self, x) -> V:
        return self._field(x, F.year)

    def f_month(self, x) -> V:
        return self._field(x, F.month)

    def f_day(self, x) -> V:
        return self._field(x, F.dayofmonth)

    def f_hour(self, x) -> V:
        return self._field(x, F.hour)

    def f_minute(self, x) -> V:
        return self._field(x, F.minute)

    def f_second(self, x) -> V:
        return self._field(x, F.second)

    def f_weekday(self, x, kind=("num", "1")) -> V:
        v, k = self._d(x), self.num(kind)
        monday = F.weekday(v.c)
        out = F.when(k.c == 1, F.dayofweek(v.c)).when(k.c == 2, monday + 1).when(k.c == 3, monday)
        return V(out.cast("double"), _or(v.e, k.e, ~k.c.isin(1.0, 2.0, 3.0)), "num")

    def f_weeknum(self, x, kind=("num", "1")) -> V:
        v, k = self._d(x), self.num(kind)
        first = F.trunc(v.c, "year")
        sunday = F.floor((F.dayofyear(v.c) + F.dayofweek(first) - 2) / 7) + 1
        monday = F.floor((F.dayofyear(v.c) + F.weekday(first) - 1) / 7) + 1
        out = F.when(k.c == 1, sunday).when(k.c == 2, monday).when(k.c == 21, F.weekofyear(v.c))
        return V(out.cast("double"), _or(v.e, k.e, ~k.c.isin(1.0, 2.0, 21.0)), "num")

    def f_days(self, end, start) -> V:
        a, b = self._d(end), self._d(start)
        return V(F.datediff(a.c.cast("date"), b.c.cast("date")).cast("double"), _or(a.e, b.e), "num")

    def f_datedif(self, start, end, unit) -> V:
        a, b = self._d(start), self._d(end)
        u = unit[1].lower() if unit[0] == "text" else "d"
        x, y = a.c.cast("date"), b.c.cast("date")
        months = (F.year(y) - F.year(x)) * 12 + F.month(y) - F.month(x) - (F.dayofmonth(y) < F.dayofmonth(x)).cast("int")
        out = {"d": F.datediff(y, x), "m": months, "y": F.floor(months / 12)}[u]
        return V(out.cast("double"), _or(a.e, b.e, F.coalesce(x > y, F.lit(False))), "num")

    def f_date(self, y, m, d) -> V:
        (a, b, c), e = self._n(y, m, d)
        first = F.make_date(a.cast("int"), F.lit(1), F.lit(1))
        return V(F.date_add(F.add_months(first, (b - 1).cast("int")), (c - 1).cast("int")), e, "date")

    def f_today(self) -> V:
        return V(F.lit(self.now[:10]).cast("date"), None, "date")

    def f_now(self) -> V:
        return V(F.lit(self.now).cast("timestamp_ntz"), None, "date")

    def f_edate(self, x, n) -> V:
        v, k = self._d(x), self.num(n)
        return V(F.add_months(v.c.cast("date"), F.floor(k.c).cast("int")), _or(v.e, k.e), "date")

    def f_eomonth(self, x, n=("num", "0")) -> V:
        v, k = self._d(x), self.num(n)
        return V(F.last_day(F.add_months(v.c.cast("date"), F.floor(k.c).cast("int"))), _or(v.e, k.e), "date")

    # -- whole columns -------------------------------------------------------

    def _bare(self, n) -> V:
        if n[0] != "column":
            raise FormulaError("a column is needed")
        return self.num(n)

    def _over(self, ordered: bool = False):
        w = Window.partitionBy(*self.by)
        if not ordered:
            return w
        if self.order is None:
            raise FormulaError("the row order is not known")
        return w.orderBy(self.order)

    def f_rownumber(self) -> V:
        return V(F.row_number().over(self._over(True)).cast("double"), None, "num")

    def f_previous(self, x) -> V:
        v = self.node(x)
        if x[0] != "column":
            raise FormulaError("a column is needed")
        return V(F.lag(v.c).over(self._over(True)), None, v.t)

    def f_runningsum(self, x) -> V:
        v = self._bare(x)
        return V(F.when(v.c.isNotNull(), F.sum(v.c).over(self._over(True).rowsBetween(Window.unboundedPreceding, 0))), None, "num")

    def f_percentoftotal(self, x) -> V:
        v = self._bare(x)
        s = F.sum(v.c).over(self._over())
        return V(F.try_divide(v.c * 100, s), F.coalesce(s == 0, F.lit(False)), "num")

    def f_rank(self, x) -> V:
        v = self._bare(x)
        return V(F.when(v.c.isNotNull(), F.rank().over(self._over().orderBy(v.c.desc_nulls_last()))).cast("double"), None, "num")

    def f_columnmean(self, x) -> V:
        return V(F.avg(self._bare(x).c).over(self._over()), None, "num")

    def f_columnmedian(self, x) -> V:
        return V(F.median(self._bare(x).c).over(self._over()), None, "num")

    def f_columnstdev(self, x) -> V:
        c = self._bare(x).c
        return V(F.stddev_samp(c).over(self._over()), F.count(c).over(self._over()) < 2, "num")

    def f_bin(self, x, n) -> V:
        v, k = self._bare(x), self.num(n)
        lo, hi = F.min(v.c).over(self._over()), F.max(v.c).over(self._over())
        width = (hi - lo) / k.c
        return V(F.when(v.c.isNotNull(), F.when(width == 0, F.lit(1.0)).otherwise(F.greatest(F.lit(1.0), F.ceil(F.try_divide(v.c - lo, width)).cast("double")))), k.e, "num")


class _Attached(Compiler):
    """Whole-column functions as columns that ``attach`` makes, all at once.

    Totals are one row that is broadcast; functions of the row order run range
    by range.  With partitions (``by``) the windows of the base class are right,
    as each partition is its own.
    """

    def __init__(self, df: DataFrame, order: str | None, now: str):
        super().__init__(df, order, now)
        self.totals: list[Column] = []
        self.ordered: list[tuple[str, str, Column | None]] = []
        self.ranks: list[tuple[str, Column]] = []

    def attach(self, df: DataFrame) -> DataFrame:
        from ..operators import order

        if self.totals:
            df = df.join(F.broadcast(df.agg(*self.totals)))
        if self.ordered:
            df = order.attach(df, self.order, self.ordered)
        for name, value in self.ranks:
            df = order.rank_desc(df, value, name)
        return df

    def _total(self, how: Column) -> Column:
        name = f"_total{len(self.totals)}"
        self.totals.append(how.alias(name))
        return F.col(name)

    def _in_order(self, kind: str, value: Column | None) -> Column:
        if self.order is None:
            raise FormulaError("the row order is not known")
        name = f"_order{len(self.ordered)}"
        self.ordered.append((name, kind, value))
        return F.col(name)

    def f_rownumber(self) -> V:
        return V(self._in_order("number", None).cast("double"), None, "num")

    def f_previous(self, x) -> V:
        v = self.node(x)
        if x[0] != "column":
            raise FormulaError("a column is needed")
        return V(self._in_order("previous", v.c), None, v.t)

    def f_runningsum(self, x) -> V:
        v = self._bare(x)
        return V(F.when(v.c.isNotNull(), self._in_order("sum", v.c)), None, "num")

    def f_rank(self, x) -> V:
        v = self._bare(x)
        self.ranks.append((f"_rank{len(self.ranks)}", v.c))
        return V(F.col(self.ranks[-1][0]).cast("double"), None, "num")

    def f_percentoftotal(self, x) -> V:
        v = self._bare(x)
        s = self._total(F.sum(v.c))
        return V(F.try_divide(v.c * 100, s), F.coalesce(s == 0, F.lit(False)), "num")

    def f_columnmean(self, x) -> V:
        return V(self._total(F.avg(self._bare(x).c)), None, "num")

    def f_columnmedian(self, x) -> V:
        return V(self._total(F.median(self._bare(x).c)), None, "num")

    def f_columnstdev(self, x) -> V:
        s = self._total(F.stddev_samp(self._bare(x).c))
        return V(s, s.isNull(), "num")

    def f_bin(self, x, n) -> V:
        v, k = self._bare(x), self.num(n)
        lo, hi = self._total(F.min(v.c)), self._total(F.max(v.c))
        width = (hi - lo) / k.c
        return V(F.when(v.c.isNotNull(), F.when(width == 0, F.lit(1.0)).otherwise(F.greatest(F.lit(1.0), F.ceil(F.try_divide(v.c - lo, width)).cast("double")))), k.e, "num")


def apply(df: DataFrame, formulas: dict[str, str], order: str | None = None, now: str = "2024-01-01 00:00:00", by: tuple[str, ...] = ()) -> DataFrame:
    """``df`` with a column for each formula; one that cannot be read adds nothing.

    Formulas over columns of ``df`` are added together; one over a new column
    waits for it.
    """
    fresh = lambda: Compiler(df, order, now, by) if by else _Attached(df, order, now)
    comp, pending = fresh(), {}

    def flush() -> DataFrame:
        base = comp.attach(df) if isinstance(comp, _Attached) else df
        kept = [c for c in df.columns if c not in pending]
        return base.withColumns(pending).select(*[F.col(f"`{c}`") for c in kept], *pending) if pending else df

    for name, text in formulas.items():
        for _ in range(2):
            try:
                pending[name] = comp.column(text)
                break
            except FormulaError:
                if not any(n.lower() in text.lower() for n in pending):
                    break
                df = flush()
                comp, pending = fresh(), {}
    return flush()
