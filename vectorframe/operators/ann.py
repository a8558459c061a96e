"""Approximate search by an inverted file of cells, with exact distances at the end.

Cells are the clusters of k-means centres fitted on a bounded sample; each row is filed under
its nearest centre, in a table partitioned by cell, so that a search reads the few cells
nearest to its query and no other files. Rows written since are searched exactly and merged.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vectorframe.schema import RID, Field

#: Rows sampled for the centres, at most, and rounds of k-means.
SAMPLE, ROUNDS = 50_000, 12
#: Share of the cells that a search reads unless told otherwise: a recall of 0.9 even where vectors have no clusters.
PROBE_SHARE = 0.8


def _nearest(x: np.ndarray, centres: np.ndarray, n: int = 1) -> np.ndarray:
    d = (centres**2).sum(axis=1) - 2 * x @ centres.T
    return np.argsort(d, axis=1, kind="stable")[:, :n]


def fit_centres(rows: DataFrame, field: str, cells: int, sample: int = SAMPLE, seed: int = 5) -> np.ndarray:
    """Centres from at most ``sample`` rows, those with the smallest hashes of their ids."""
    found = rows.select(field).where(F.col(field).isNotNull()).orderBy(F.xxhash64(F.col(RID), F.lit(seed)), RID).limit(sample) if RID in rows.columns else rows.select(field).limit(sample)
    x = np.array([r[0] for r in found.collect()], dtype=np.float64)
    if not len(x):
        return np.zeros((1, 1))
    rng = np.random.default_rng(seed)
    centres = x[rng.choice(len(x), min(cells, len(x)), replace=False)]
    for _ in range(ROUNDS):
        of = _nearest(x, centres)[:, 0]
        sums = np.zeros_like(centres)
        np.add.at(sums, of, x)
        n = np.bincount(of, minlength=len(centres))
        centres = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], centres)
    return centres


def cell_of(field: str, centres: np.ndarray):
    @F.arrow_udf(T.IntegerType())
    def cell(column: pa.Array) -> pa.Array:
        x = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)
        return pa.array(_nearest(x, centres)[:, 0].astype(np.int32) if len(x) else np.zeros(0, np.int32))

    return cell(F.col(field))


def build(rows: DataFrame, field: Field, uri: str, cells: int | None = None) -> np.ndarray:
    """File rows by cell below ``uri``; the centres. By default about the square root of the rows."""
    if cells is None:
        cells = int(min(4096, max(1, rows.count() ** 0.5)))
    centres = fit_centres(rows, field.name, cells)
    filed = rows.withColumn("__cell", cell_of(field.name, centres))
    filed.repartition("__cell").write.mode("overwrite").partitionBy("__cell").parquet(uri)
    return centres


def probe(spark, uri: str, schema: T.StructType, query: list[float], centres: np.ndarray, probes: int = 0) -> DataFrame:
    """Rows of the ``probes`` cells nearest to the query (0: ``PROBE_SHARE`` of all); only their folders are read."""
    probes = probes or int(np.ceil(PROBE_SHARE * len(centres)))
    cells = _nearest(np.asarray([query], dtype=np.float64), centres, probes)[0]
    stored = T.StructType([*schema.fields, T.StructField("__cell", T.IntegerType())])
    return spark.read.schema(stored).parquet(uri).where(F.col("__cell").isin(*[int(c) for c in cells])).drop("__cell")
