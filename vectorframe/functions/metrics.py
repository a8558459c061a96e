"""Distances between stored vectors and a query vector; smaller is always closer.

Dense vectors have two equal forms: higher-order functions in the JVM, and an Arrow UDF that
multiplies a whole batch in numpy. The UDF is used from ``ARROW_DIMENSIONS`` on.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vectorframe.errors import EngineError, InvalidPayload
from vectorframe.schema import DENSE, SPARSE, Field

ARROW_DIMENSIONS = 32


def _sum(items: Column) -> Column:
    return F.aggregate(items, F.lit(0.0), lambda s, x: s + x)


def _products(a: Column, b: Column) -> Column:
    return _sum(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")))


def norm(v: Column) -> Column:
    return F.sqrt(_products(v, v))


def normalize_dense(v: Column) -> Column:
    """Unit length, as float; left alone if the squared length is at most 1e-10."""
    n = _products(v, v)
    return F.when(n > 1e-10, F.transform(v, lambda x: (x.cast("double") / F.sqrt(n)).cast("float"))).otherwise(v)


def normalize_sparse(v: Column) -> Column:
    n = _products(v["values"], v["values"])
    values = F.when(n > 1e-10, F.transform(v["values"], lambda x: (x.cast("double") / F.sqrt(n)).cast("float"))).otherwise(v["values"])
    return F.struct(v["indices"].alias("indices"), values.alias("values"))


def dense_hof(v: Column, query: list[float], metric: str) -> Column:
    q = F.array(*[F.lit(float(x)) for x in query])
    if metric == "EUCLIDEAN":
        return _sum(F.zip_with(v, q, lambda x, y: (x.cast("double") - y) * (x.cast("double") - y)))
    dot = _products(v, q)
    return F.lit(1.0) - dot if metric == "COSINE" else -dot


def dense_arrow(v: Column, query: list[float], metric: str, once: bool = False) -> Column:
    q = np.asarray(query, dtype=np.float64)

    @F.arrow_udf(T.DoubleType())
    def distance(column: pa.Array) -> pa.Array:
        out = np.full(len(column), np.nan)
        size = column.value_lengths().fill_null(-1).to_numpy(zero_copy_only=False)
        ok = size == len(q)
        if ok.any():
            m = column.filter(pa.array(ok)).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, len(q))
            if metric == "EUCLIDEAN":
                m -= q
                out[ok] = np.einsum("ij,ij->i", m, m)
            else:
                out[ok] = (1.0 if metric == "COSINE" else 0.0) - m @ q
        return pa.array(out, mask=~ok)

    # marked as not to be repeated, it is evaluated below a filter that speaks of it, and there alone
    return (distance.asNondeterministic() if once else distance)(v)


def sparse_dot(v: Column, indices: list[int], values: list[float]) -> Column:
    """Sum over shared indices: the query is a map, looked up for each stored entry."""
    if not indices:
        return F.lit(0.0)
    q = F.create_map(*[F.lit(x) for pair in zip(indices, map(float, values)) for x in pair])
    return _sum(F.zip_with(v["indices"], v["values"], lambda i, x: x.cast("double") * F.coalesce(F.try_element_at(q, i), F.lit(0.0))))


def sparse(v: Column, query: dict, metric: str) -> Column:
    dot = sparse_dot(v, query["indices"], query["values"])
    if metric == "DOT_PRODUCT":
        return -dot
    mine = float(np.square(np.asarray(query["values"], dtype=np.float64)).sum())
    other = _products(v["values"], v["values"])
    if metric == "EUCLIDEAN":
        return other + F.lit(mine) - F.lit(2.0) * dot
    both = F.sqrt(other * F.lit(mine))
    return F.when(both == 0, F.lit(float("nan"))).otherwise(F.lit(1.0) - dot / both)


def check_query(field: Field, query: object) -> list[float] | dict:
    """The query in checked form: a list for dense fields, indices and values for sparse ones."""
    if isinstance(query, dict):
        if set(query) != {"indices", "values"} or len(query["indices"]) != len(query["values"]):
            raise InvalidPayload("a sparse query needs as many indices as values")
        if field.type not in SPARSE:
            raise EngineError("a sparse query can't search a dense field")
        if any(b <= a for a, b in zip(query["indices"], query["indices"][1:])) or any(not 0 <= i < field.dimensions for i in query["indices"]):
            raise EngineError("indices of a sparse query must rise and lie within the dimensions")
        return query
    if not isinstance(query, (list, tuple)):
        raise InvalidPayload("a query vector is a list, or indices and values")
    if field.type not in DENSE:
        raise EngineError("a dense query can't search a sparse field")
    if len(query) != field.dimensions:
        raise EngineError(f"the query has {len(query)} dimensions, the field {field.dimensions}")
    return [float(x) for x in query]


def distance(field: Field, query: list[float] | dict, arrow: bool | None = None, once: bool = False) -> Column:
    """Distance of ``field`` to a checked query. Stored COSINE vectors have unit length; the query is given it."""
    v = F.col(field.name)
    if field.type in SPARSE:
        return sparse(v, query, field.metric)
    if field.metric == "COSINE":
        size = float(np.sqrt(np.square(np.asarray(query, dtype=np.float64)).sum()))
        query = [x / size if size else float("nan") for x in query]
    if arrow is None:
        arrow = field.dimensions >= ARROW_DIMENSIONS
    return dense_arrow(v, query, field.metric, once) if arrow else dense_hof(v, query, field.metric)
