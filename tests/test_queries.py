"""Every query of the engine against its SQL in DuckDB, and what the entry module promises."""

from __future__ import annotations

import subprocess
import sys

import duckdb
import numpy as np
import pytest

from tests.conftest import DATA, ROOT
from vectorframe.queries import K, QUERIES, SQL

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="session")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(SQL))
def test_against_sql(spark, sf_dir, duck, name):
    a, b = QUERIES[name](spark, sf_dir).toPandas(), duck.sql(SQL[name]).df()
    names = sorted(a.columns)
    assert names == sorted(b.columns)
    a, b = (x[names].sort_values(names).reset_index(drop=True) for x in (a, b))
    assert len(a) == len(b)
    for c in names:
        if np.issubdtype(b[c].dtype, np.floating):
            np.testing.assert_allclose(a[c], b[c], atol=2e-5)
        else:
            assert a[c].tolist() == b[c].tolist(), c


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", ["equal", "less", "greater_equal", "and", "in"])
def test_filters_reach_the_scan(spark, sf_dir, name):
    plan = plan_of(QUERIES[f"filter_{name}"](spark, sf_dir))
    assert "Exchange" not in plan and "Sort" not in plan and "PushedFilters: []" not in plan and "DataFilters: []" not in plan


def test_distance_filters_evaluate_once(spark, sf_dir):
    for name in ("knn_distance_filter", "knn_distance_scope"):
        plan = plan_of(QUERIES[name](spark, sf_dir))
        assert plan.count("ArrowEvalPython") == 1 and "TakeOrdered" not in plan and "Exchange" not in plan


def test_approximate_recall(spark, sf_dir):
    near = {r.vec_id for r in QUERIES["knn_approximate"](spark, sf_dir).collect()}
    exact = {r.vec_id for r in QUERIES["knn_euclidean"](spark, sf_dir).collect()}
    assert len(near) == K and len(near & exact) >= 0.9 * K


def test_text_query(spark, sf_dir):
    rows = QUERIES["knn_text"](spark, sf_dir).orderBy("distance").collect()
    assert len(rows) == K and rows[0].p_name == "blue widget" and rows[0].distance == pytest.approx(0, abs=1e-5)


def test_entry_without_llm(tmp_path):
    """The entry module still works when the llm folders and the pipeline are gone."""
    import shutil

    shutil.copytree(ROOT / "vectorframe", tmp_path / "vectorframe", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(ROOT / "__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e; q = e.queries(); assert 'knn_filtered' in q and not any(k.startswith('op') or k == 'pipeline' for k in q); assert set(e.oracle_sql()) <= set(q)"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, env={"PATH": "/usr/bin:/bin", "PYTHONPATH": str(tmp_path)})


def test_entry(spark):
    sys.path.insert(0, str(ROOT))
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())
    assert e.entry(spark).columns == ["vec_id", "label", "distance"]
