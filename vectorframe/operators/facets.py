"""Facets: one grouping expression and aggregates over the rows of a result."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vectorframe.errors import InvalidExpr, InvalidPayload
from vectorframe.plans.compiler import Compiler
from vectorframe.plans.parser import BOOL, INT, STRING, Node, parse

_CALL = re.compile(r"\s*(SUM|MIN|MAX|COUNT|AVG)\((.*)\)\s*", re.IGNORECASE | re.DOTALL)


def _whole(column: Column) -> Column:
    return F.expr("1") if column is None else column.try_cast("bigint")


def _number(n: Node, compiler: Compiler, text: str) -> Column:
    if n.type in (STRING, BOOL):
        raise InvalidExpr(f"an aggregate takes numbers: {text}")
    return compiler.number(n)


def facet(rows: DataFrame, spec: dict, fields: dict[str, str], distance: Column | None = None, extensions: bool = False) -> DataFrame:
    """Groups of ``rows`` for a facet {group: [expression], aggregate: [call, ...]}.

    Keys and aggregates are named by their text. No group, or an empty input, gives no key
    column, or no rows. ``extensions`` allows several keys and AVG.
    """
    groups, calls = list(spec.get("group", [])), list(spec.get("aggregate", []))
    if not calls:
        raise InvalidPayload("a facet needs an aggregate")
    if len(groups) > 1 and not extensions:
        raise InvalidPayload("a facet takes one group")
    compiler = Compiler(distance)
    keys, made = [], []
    for g in groups:
        n = parse(g, fields, boolean=False)
        c = compiler.value(n)
        keys.append((g, c.try_cast("bigint") if n.type == INT else c))
    for call in calls:
        m = _CALL.fullmatch(call)
        if not m or (m[1].upper() == "AVG" and not extensions):
            raise InvalidExpr(f"unknown aggregate: {call}")
        name = m[1].upper()
        if name == "COUNT":
            made.append(F.count(F.lit(1)).alias(call))
            continue
        n = parse(m[2], fields, boolean=False)
        out = {"SUM": F.sum, "MIN": F.min, "MAX": F.max, "AVG": F.avg}[name](_number(n, compiler, call))
        made.append((out.try_cast("bigint") if n.type == INT and name != "AVG" else out).alias(call))
    # a constant column, as an aggregate without keys has a row even for no input
    names = [f"__key{i}" for i in range(len(keys))] or ["__key0"]
    keyed = rows.withColumns(dict(zip(names, [c for _, c in keys] or [F.lit(1)])))
    done = keyed.groupBy(*names).agg(*made)
    return done.select(*[F.col(n).alias(g) for n, (g, _) in zip(names, keys)], *[F.col(f"`{c}`") for c in calls])
