"""Typed trees to Spark columns.

Comparisons of a field with a literal stay in the field's own type, so that they reach the
Parquet scan; arithmetic is in doubles with IEEE results for zero divisors; patterns become
anchored expressions with a plain prefix test that can be pushed down.
"""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from vectorframe.functions.geo import within
from vectorframe.plans.parser import DOUBLE, INT, STRING, Node
from vectorframe.schema import INTEGERS

_ANY = r"[^\n\r\u2028\u2029]"


def like_regex(pattern: str) -> str:
    """% is any run and _ one character, neither with line ends; all else is literal."""
    return r"\A" + "".join(f"{_ANY}*" if c == "%" else _ANY if c == "_" else re.escape(c) for c in pattern) + r"\z"


def _like(s: Column, pattern: Node, p: Column) -> Column:
    if pattern.op == "literal":
        text = pattern.value
        if text == "%":
            return F.lit(True)
        if "%" not in text and "_" not in text:
            return s == F.lit(text)
        prefix = re.split("[%_]", text, maxsplit=1)[0]
        match = s.rlike(like_regex(text))
        return s.startswith(prefix) & match if prefix else match
    quoted = F.regexp_replace(p, r"([\\^$.|?*+()\[\]{}])", r"\\$1")
    body = F.replace(F.replace(quoted, F.lit("%"), F.lit(f"{_ANY}*")), F.lit("_"), F.lit(_ANY))
    return F.when(p == "%", F.lit(True)).when(p == "", s == "").otherwise(F.regexp_like(s, F.concat(F.lit(r"\A"), body, F.lit(r"\z"))))


def divide(a: Column, b: Column) -> Column:
    return F.when(b == 0, F.when(F.isnan(a) | (a == 0), F.lit(float("nan"))).when(a > 0, F.lit(float("inf"))).otherwise(F.lit(float("-inf")))).otherwise(a / b)


def remainder(a: Column, b: Column) -> Column:
    return F.when(b == 0, F.lit(float("nan"))).otherwise(a % b)


_COMPARE = {
    "=": lambda a, b: a == b, "<>": lambda a, b: a != b, "<": lambda a, b: a < b, "<=": lambda a, b: a <= b,
    ">": lambda a, b: a > b, ">=": lambda a, b: a >= b,
}


class Compiler:
    """``distance`` is the column that @distance stands for (0 where there is none)."""

    def __init__(self, distance: Column | None = None, compat_distance_scope: bool = False):
        self.distance = F.lit(0.0) if distance is None else distance
        self.compat = compat_distance_scope

    def number(self, n: Node, logical: bool = False) -> Column:
        """The node as a double."""
        if n.op == "literal":
            return F.lit(float(n.value))
        if n.op == "field":
            return F.col(n.value[0]).cast("double")
        if n.op == "distance":
            return F.lit(0.0) if logical and self.compat else self.distance
        a, b = (self.number(x, logical) for x in n.args)
        return {"+": lambda: a + b, "-": lambda: a - b, "*": lambda: a * b, "/": lambda: divide(a, b), "%": lambda: remainder(a, b)}[n.op]()

    def _compare(self, n: Node, logical: bool) -> Column:
        a, b = n.args
        if {a.op, b.op} == {"field", "literal"} and a.type != STRING:
            f, v = (a, b) if a.op == "field" else (b, a)
            name, kind = f.value
            exact = kind in INTEGERS and v.type == INT or kind in ("DOUBLE", "BOOL")
            if exact:  # the field's own type, which the scan can test
                sides = F.col(name), F.lit(float(v.value) if kind == "DOUBLE" else v.value)
                return _COMPARE[n.op](*(sides if a is f else sides[::-1]))
        if a.type in (INT, DOUBLE):
            x, y = self.number(a, logical), self.number(b, logical)
            out = _COMPARE[n.op](x, y)
            for node, column in ((a, x), (b, y)):
                if node.has("/", "%", "distance"):  # NaN equals nothing and is neither less nor greater
                    out = out | F.isnan(column) if n.op == "<>" else out & ~F.isnan(column)
            return out
        return _COMPARE[n.op](self.value(a, logical), self.value(b, logical))

    def value(self, n: Node, logical: bool = False) -> Column:
        """The node in its own kind: double, string or boolean."""
        if n.type in (INT, DOUBLE):
            return self.number(n, logical)
        if n.op == "literal":
            return F.lit(n.value)
        if n.op == "field":
            return F.col(n.value[0])
        if n.op == "nearby":
            return within(F.col(n.value[0]), *n.value[1:])
        if n.op == "+":
            return F.concat(*(self.value(a, logical) for a in n.args))
        if n.op == "LIKE":
            return _like(self.value(n.args[0], logical), n.args[1], self.value(n.args[1], logical))
        if n.op == "IN":
            return F.col(n.args[0].value[0]).isin(*n.value)
        if n.op == "NOT":
            return ~self.value(n.args[0], True)
        if n.op in ("AND", "OR"):
            a, b = (self.value(x, True) for x in n.args)
            return a & b if n.op == "AND" else a | b
        return self._compare(n, logical)
