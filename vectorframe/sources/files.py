"""Bulk sources: files of rows in the columns of a table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vectorframe.schema import DENSE, SPARSE, Table


def read_csv(spark: SparkSession, path: str, table: Table, header: bool = True) -> DataFrame:
    """A CSV file in the order of the table's fields (or by its header); vectors and points are JSON text."""
    fields = [f for f in table.fields if not f.index]
    rows = spark.read.csv(path, header=header, escape='"', schema=", ".join(f"`{f.name}` string" for f in fields))
    out = []
    for f in fields:
        c, kind = F.col(f"`{f.name}`"), f.spark().dataType
        out.append((F.from_json(c, kind) if f.type in DENSE | SPARSE | {"GEO_POINT"} else c.try_cast(kind)).alias(f.name))
    return rows.select(*out)
