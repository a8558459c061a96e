"""Nearest rows of many queries: blocks against brute force, odd vectors, and the shape of the plan."""

from __future__ import annotations

import math

import numpy as np
import pytest

from tests.test_queries import plan_of
from vectorframe.functions import metrics
from vectorframe.operators import blocks, search
from vectorframe.queries import QUERIES
from vectorframe.schema import Field

METRICS = ["EUCLIDEAN", "COSINE", "DOT_PRODUCT"]


def brute(q, x, ids, k, metric):
    with np.errstate(all="ignore"):
        d = np.stack([blocks.exact(np.broadcast_to(v, x.shape), x, metric) for v in q])
    return [[(int(ids[j]), float(row[j])) for j in np.lexsort((ids, row))[:k]] for row in d]


def vectors(name):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(1500, 12)).astype(np.float32).astype(float)
    if name == "copies":
        x = np.repeat(x[:50], 30, axis=0)
    elif name == "grid":  # many equal distances
        x = rng.integers(0, 3, size=x.shape).astype(float)
    elif name == "far":  # single precision tells nothing here
        x = 1e6 + x * 1e-3
    elif name == "large":  # beyond the range of single precision, and squares beyond that of double
        x *= 10.0 ** rng.integers(-170, 170, size=(1500, 1))
    elif name == "small":
        x *= 1e-30
    elif name == "odd":
        x[7, 3], x[800, 0], x[801] = np.inf, -np.inf, np.nan
    elif name == "few":
        x = x[:4]
        x[2, 1] = np.nan
    return x[rng.permutation(len(x))]


@pytest.mark.parametrize("metric", METRICS)
@pytest.mark.parametrize("name", ["plain", "copies", "grid", "far", "large", "small", "odd", "few"])
def test_blocks_against_brute_force(name, metric, monkeypatch):
    monkeypatch.setattr(blocks, "PIECE", 64)
    monkeypatch.setattr(blocks, "FIRST", 32)
    monkeypatch.setattr(blocks, "TILE", 300)
    x = vectors(name)
    ids, q = np.random.default_rng(4).permutation(len(x)) - 5, np.concatenate([x[:150], x[-50:]])
    place, found, d = blocks.nearest(q, ((ids[i : i + 700], x[i : i + 700]) for i in range(0, len(x), 700)), 5, metric)
    want = brute(q, x, ids, 5, metric)
    assert place.tolist() == [i for i, w in enumerate(want) for _ in w]
    assert found.tolist() == [j for w in want for j, _ in w]
    np.testing.assert_array_equal(d, [y for w in want for _, y in w])


@pytest.mark.parametrize("metric", METRICS)
def test_join_against_single_searches(spark, metric, monkeypatch):
    monkeypatch.setattr(blocks, "QUERIES", 50)
    x = np.random.default_rng(5).normal(size=(300, 8)).astype(np.float32)
    x[100:200] = x[3]  # one vector a hundred times
    field = Field("v", "VECTOR_FLOAT", False, 8, metric)
    rows = spark.createDataFrame([(i, [float(y) for y in v]) for i, v in enumerate(x)], "_rid long, v array<float>").repartition(5)
    if metric == "COSINE":
        rows = rows.withColumn("v", metrics.normalize_dense(rows.v))
    asked = spark.createDataFrame([(f"q{i}", [float(y) for y in x[i]]) for i in range(0, 300, 3)], "name string, q array<float>")
    got = search.knn_join(rows, field, asked, "name", "q", 4).collect()
    assert len(got) == 400
    stored = {r._rid: np.array(r.v, dtype=float) for r in rows.collect()}
    ids, m = np.array(sorted(stored)), np.stack([stored[i] for i in sorted(stored)])
    units = asked.select("name", (metrics.normalize_dense(asked.q) if metric == "COSINE" else asked.q).alias("q")).collect()
    want = {r.name: brute(np.array([r.q], dtype=float), m, ids, 4, metric)[0] for r in units}
    assert {(r.name, r.rank): (r._rid, r["@distance"]) for r in got} == {(n, i + 1): w for n, ws in want.items() for i, w in enumerate(ws)}


def test_join_of_odd_vectors(spark):
    """Null distances come last, as in SQL: no vector, another length, null within."""
    rows = spark.createDataFrame([(0, None), (1, [1.0]), (2, [None, 1.0]), (3, [0.0, 0.0]), (4, [1.0, 1.0]), (5, [math.nan, 0.0])], "_rid long, v array<double>")
    asked = spark.createDataFrame([(1, [0.0, 0.1]), (2, None), (None, [1.0, 1.0]), (4, [math.nan, 1.0])], "q int, w array<double>")
    got = search.knn_join(rows, Field("v", "VECTOR_DOUBLE", False, 2, "EUCLIDEAN"), asked, "q", "w", 4).collect()
    found = {q: [r._rid for r in sorted(got, key=lambda r: r.rank) if r.q == q] for q in (1, 2, None, 4)}
    assert found == {1: [3, 4, 5, 0], 2: [0, 1, 2, 3], None: [4, 3, 5, 0], 4: [3, 4, 5, 0]}
    assert [r["@distance"] for r in got if r.q == 2] == [None] * 4


def test_join_of_null_row_ids(spark):
    """Rows without ids count, and come last among equal distances."""
    rows = spark.createDataFrame([(None, [1.0]), (None, [1.0]), (1, [1.0]), (2, [3.0]), (None, None), (3, None)], "_rid long, v array<float>")
    asked = spark.createDataFrame([(1, [1.0]), (2, None)], "q int, w array<float>")
    got = search.knn_join(rows, Field("v", "VECTOR_FLOAT", False, 1, "EUCLIDEAN"), asked, "q", "w", 6).orderBy("q", "rank").collect()
    assert [r._rid for r in got] == [1, None, None, 2, 3, None, 1, 2, 3, None, None, None]
    assert [r["@distance"] for r in got] == [0.0, 0.0, 0.0, 4.0, None, None] + [None] * 6


def test_join_of_empty_tables(spark):
    field, some = Field("v", "VECTOR_FLOAT", False, 2, "EUCLIDEAN"), spark.createDataFrame([(0, [1.0, 2.0])], "_rid long, v array<float>")
    asked = some.toDF("q", "w")
    assert search.knn_join(some.limit(0), field, asked, "q", "w", 3).count() == 0
    assert search.knn_join(some, field, asked.limit(0), "q", "w", 3).count() == 0
    assert search.knn_join(some, field, asked, "q", "w", 0).count() == 0


def test_equal_query_ids_share_their_rows(spark):
    rows = spark.createDataFrame([(i, [float(i)]) for i in range(9)], "_rid long, v array<float>")
    asked = spark.createDataFrame([(7, [0.0]), (7, [8.0])], "q int, w array<float>")
    got = search.knn_join(rows, Field("v", "VECTOR_FLOAT", False, 1, "EUCLIDEAN"), asked, "q", "w", 4).orderBy("rank").collect()
    assert [(r._rid, r["@distance"]) for r in got] == [(0, 0.0), (8, 0.0), (1, 1.0), (7, 1.0)]


def test_join_broadcasts_no_table(spark, sf_dir):
    plan = plan_of(QUERIES["knn_join"](spark, sf_dir))
    assert "NestedLoop" not in plan and "Cartesian" not in plan and "Broadcast" not in plan
