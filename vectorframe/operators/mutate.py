"""Mutations: checked records to rows, duplicates of keys, and what a deletion hits."""

from __future__ import annotations

import json
import math
import struct

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from vectorframe.errors import EngineError, InvalidPayload, InvalidRecord
from vectorframe.functions import metrics
from vectorframe.operators.search import types_of
from vectorframe.plans.compiler import Compiler
from vectorframe.plans.parser import parse
from vectorframe.schema import DENSE, INTEGERS, RID, SPARSE, Field, Table


def _wrap(value: object, bits: int) -> int:
    """An integer as a machine holds it; 0 for what isn't a number."""
    if isinstance(value, bool) or not isinstance(value, (int, float)) or (isinstance(value, float) and not math.isfinite(value)):
        return 0
    return (int(value) + (1 << bits - 1)) % (1 << bits) - (1 << bits - 1)


def _real(value: object) -> float:
    return float(value) if isinstance(value, (int, float)) and not isinstance(value, bool) else 0.0


def _float32(value: object) -> float:
    try:
        return struct.unpack("f", struct.pack("f", _real(value)))[0]
    except OverflowError:
        return math.copysign(math.inf, _real(value))


def _unit(values: list[float]) -> list[float]:
    n = math.sqrt(sum(x * x for x in values))
    return [_float32(x / n) for x in values] if n * n > 1e-10 else values


class Skip(Exception):
    """The record is left out and counted."""


def _sparse(value: object, field: Field) -> tuple[list[int], list[float]]:
    indices, values = (value.get(k, []) for k in ("indices", "values")) if isinstance(value, dict) else ([], [])
    indices = [_wrap(i, 64) for i in indices]
    if len(indices) != len(values) or not indices or indices[-1] >= field.dimensions or min(indices) < 0:
        raise Skip
    if any(b <= a for a, b in zip(indices, indices[1:])):
        raise Skip
    values = [_float32(x) for x in values]
    return indices, _unit(values) if field.metric == "COSINE" else values


def convert(value: object, field: Field) -> object:
    """A JSON value in the type of its field; wrong types become zero, empty or false."""
    if field.type in INTEGERS:
        return _wrap(value, INTEGERS[field.type])
    if field.type == "FLOAT":
        return _float32(value)
    if field.type == "DOUBLE":
        return _real(value)
    if field.type == "STRING":
        return value if isinstance(value, str) else ""
    if field.type == "BOOL":
        return value if isinstance(value, bool) else False
    if field.type == "JSON":
        return json.dumps(value)
    if field.type == "GEO_POINT":
        point = value if isinstance(value, dict) else {}
        return (min(90.0, max(-90.0, _real(point.get("latitude")))), min(180.0, max(-180.0, _real(point.get("longitude")))))
    if field.type in SPARSE:
        return _sparse(value, field)
    if not isinstance(value, list) or len(value) != field.dimensions:
        raise Skip
    values = [_float32(x) for x in value]
    return _unit(values) if field.metric == "COSINE" else values


def rows_of(records: list[dict], table: Table) -> tuple[list[tuple], int]:
    """Values of the fields that aren't indices, and how many records were left out.

    A record without a field voids the whole batch.
    """
    fields = [f for f in table.fields if not f.index]
    for r in records:
        for f in fields:
            if not isinstance(r, dict) or f.name not in r:
                raise InvalidRecord(f"a record lacks the field {f.name}")
    out = []
    for r in records:
        try:
            out.append(tuple(convert(r[f.name], f) for f in fields))
        except Skip:
            continue
    return out, len(records) - len(out)


def frame_of(spark: SparkSession, rows: list[tuple], table: Table) -> DataFrame:
    """Rows with their place in the batch as _rid."""
    schema = table.spark()
    schema.fields = [f for f in schema.fields if not f.metadata.get("index")]
    return spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], schema)


def checked(df: DataFrame, table: Table) -> DataFrame:
    """Bulk form of ``rows_of`` for a DataFrame with the table's columns: casts, skips and unit vectors in the JVM."""
    missing = [f.name for f in table.fields if not f.index and f.name not in df.columns]
    if missing:
        raise InvalidRecord(f"the rows lack the field {missing[0]}")
    keep: Column = F.lit(True)
    out = []
    for f in table.fields:
        if f.index:
            continue
        kind, c = f.spark().dataType, F.col(f"`{f.name}`")
        if f.type in DENSE:
            c = c.cast("array<float>")
            keep = keep & F.coalesce((F.size(c) == f.dimensions) & ~F.exists(c, F.isnull), F.lit(False))
            c = metrics.normalize_dense(c) if f.metric == "COSINE" else c
        elif f.type in SPARSE:
            c = c.cast("struct<indices:array<bigint>,values:array<float>>")
            i, v = c["indices"], c["values"]
            keep = keep & F.coalesce(~F.exists(i, F.isnull) & ~F.exists(v, F.isnull), F.lit(False))
            rises = F.forall(F.sequence(F.lit(1), F.size(i) - 1), lambda k: F.get(i, k) > F.get(i, k - 1))
            keep = keep & F.coalesce((F.size(i) == F.size(v)) & (F.size(i) > 0) & (F.element_at(i, -1) < f.dimensions) & (F.array_min(i) >= 0) & F.when(F.size(i) > 1, rises).otherwise(True), F.lit(False))
            c = metrics.normalize_sparse(c) if f.metric == "COSINE" else c
        elif f.type == "GEO_POINT":
            c = F.struct(F.greatest(F.lit(-90.0), F.least(F.lit(90.0), F.coalesce(c["latitude"], F.lit(0.0)))).alias("latitude"), F.greatest(F.lit(-180.0), F.least(F.lit(180.0), F.coalesce(c["longitude"], F.lit(0.0)))).alias("longitude"))
        else:
            zero = {"STRING": "", "JSON": "null", "BOOL": False}.get(f.type, 0)
            c = F.coalesce(c.try_cast(kind), F.lit(zero).cast(kind))
        out.append(c.alias(f.name))
    return df.where(keep).select(F.monotonically_increasing_id().alias(RID), *out)


def first_of_batch(rows: DataFrame, key: str, last: bool) -> DataFrame:
    """One row of each key: the first for insertion, the last for upsertion."""
    order = F.col(RID).desc() if last else F.col(RID).asc()
    n = F.row_number().over(Window.partitionBy(key).orderBy(order))
    return rows.withColumn("__n", n).where("__n = 1").drop("__n")


def new_rows(base: DataFrame, rows: DataFrame, key: str | None) -> DataFrame:
    """Rows of a batch to insert: keys that are new, the first of each."""
    if key is None:
        return rows
    return first_of_batch(rows, key, last=False).join(base.select(key), key, "left_anti").select(rows.columns)


def replaced(base: DataFrame, rows: DataFrame, key: str) -> DataFrame:
    """Row ids of the base whose keys a batch brings again."""
    return base.select(RID, key).join(rows.select(key), key, "left_semi").select(RID)


def upserted(base: DataFrame, rows: DataFrame, key: str | None) -> DataFrame:
    """The table after an upsert, as a plan; without a key, rows are added."""
    if key is None:
        return base.unionByName(rows)
    last = first_of_batch(rows, key, last=True)
    return base.join(last.select(key), key, "left_anti").select(base.columns).unionByName(last.select(base.columns))


def deleted(base: DataFrame, table: Table, keys: list | None, filter: str) -> DataFrame:
    """Row ids that a deletion hits: by keys, by filter, or by both."""
    if not keys and not filter:
        raise InvalidPayload("a deletion needs keys or a filter")
    hit = base.where(Compiler().value(parse(filter, types_of(table)))) if filter else base
    if keys:
        if table.key is None:
            raise InvalidPayload("the table has no primary key")
        text = table.key.type == "STRING"
        if any(isinstance(k, str) != text or isinstance(k, bool) for k in keys):
            raise InvalidPayload("a key has the wrong type")
        wanted = base.sparkSession.createDataFrame([(k,) for k in keys], f"__key {'string' if text else 'long'}")
        hit = hit.join(F.broadcast(wanted), F.col(table.key.name) == F.col("__key"), "left_semi")  # the request's own list
    return hit.select(RID)


def prepare(base: DataFrame, table: Table, keys: list, capacity: int | None = None) -> dict:
    """Rows, capacity, and 32-bit masks of a key list: bit i is set if key i is new."""
    out: dict = {"capacity": capacity, "recordNumber": base.count()}
    if keys:
        if table.key is None:
            raise EngineError("the table has no primary key")
        found = new_key_masks(base, table.key.name, keys, "string" if table.key.type == "STRING" else "long")
        out["masks"] = [r["mask"] for r in found.orderBy("word").collect()]
    return out


def new_key_masks(base: DataFrame, key: str, keys: list, kind: str) -> DataFrame:
    """(word, mask) for each 32 keys of the list."""
    listed = base.sparkSession.createDataFrame([(i, k) for i, k in enumerate(keys)], f"place long, __key {kind}")
    there = base.select(F.col(key).alias("__key")).join(F.broadcast(listed.select("__key").distinct()), "__key", "left_semi").distinct().withColumn("__there", F.lit(True))
    bit = F.when(F.col("__there"), F.lit(0)).otherwise(F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod("place", F.lit(32)).cast("int")))
    # places of a last word that the list doesn't reach stay set
    spare = (-len(keys)) % 32
    last = (len(keys) - 1) // 32
    tail = ((1 << spare) - 1) << (32 - spare) if spare else 0
    words = listed.join(there, "__key", "left").groupBy((F.floor(F.col("place") / 32)).cast("long").alias("word")).agg(F.sum(bit).alias("mask"))
    return words.select("word", (F.col("mask") + F.when(F.col("word") == last, F.lit(tail)).otherwise(F.lit(0))).cast("long").alias("mask"))
