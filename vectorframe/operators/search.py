"""Reads: nearest rows to a vector or text, and rows by key or filter."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.window import Window

from vectorframe.errors import EngineError, InvalidPayload
from vectorframe.functions import metrics
from vectorframe.operators import blocks
from vectorframe.plans.compiler import Compiler
from vectorframe.plans.parser import parse
from vectorframe.schema import RID, Field, Table
from vectorframe.sources.storage import workspace

DISTANCE = "@distance"
#: Key lists up to this length become a filter the scan can test, before they are joined.
PUSHED_KEYS = 1000


def types_of(table: Table) -> dict[str, str]:
    return {f.name: f.type for f in table.fields}


def resolve(table: Table, name: str | None, index: bool | None = None) -> Field:
    """The vector field to search; without a name, the only one there is."""
    if not name:
        found = table.vectors(index)
        if len(found) != 1:
            raise InvalidPayload("name the field to search, unless there is exactly one")
        return found[0]
    field = table.get(name)
    if field is None:
        raise EngineError(f"unknown field: {name}")
    if not field.vector:
        raise EngineError(f"{name} isn't a vector field")
    return field


def project(rows: DataFrame, table: Table, response: list[str] | None, with_distance: bool = False) -> DataFrame:
    names = list(response or table.default_response())
    unknown = [n for n in names if table.get(n) is None]
    if unknown:
        raise EngineError(f"unknown field: {unknown[0]}")
    return rows.select(*[F.col(f"`{n}`") for n in names], *([F.col(f"`{DISTANCE}`")] if with_distance else []))


def nearest(rows: DataFrame, table: Table, field: Field, query: object, limit: int | None, filter: str = "", compat_distance_scope: bool = False, max_candidates: int | None = None, arrow: bool | None = None) -> DataFrame:
    """The ``limit`` rows nearest to ``query`` that pass ``filter``, with @distance, nearest first.

    The filter goes below the distance, unless it speaks of it; ties follow row ids. Each task
    keeps its own best rows, so only ``limit`` rows of a task travel. Without a limit all rows
    that pass come back, in no order and without a shuffle.
    """
    if limit is not None and limit < 0:
        raise InvalidPayload("limit must not be negative")
    node = parse(filter or "", types_of(table))
    d = metrics.distance(field, metrics.check_query(field, query), arrow, once=node.has("distance"))
    if node.has("distance"):
        measured = rows.withColumn(DISTANCE, d)
        passed = measured.where(Compiler(F.col(f"`{DISTANCE}`"), compat_distance_scope).value(node))
    else:
        passed = rows.where(Compiler().value(node)).withColumn(DISTANCE, d)
    cut = min((n for n in (limit, max_candidates) if n is not None), default=None)
    if cut is None:
        return passed
    return passed.orderBy(F.col(f"`{DISTANCE}`").asc(), F.col(RID).asc()).limit(cut)


def lookup(rows: DataFrame, table: Table, keys: list | None = None, filter: str = "", skip: int = 0, limit: int | None = None, ordered: bool = False) -> DataFrame:
    """Rows by key (in the order of the list, repeats repeated, misses left out) and filter, or by filter alone.

    Those by filter alone are in order of row ids if ``ordered``, or where skip or limit need one;
    else in any order, as sorting a whole result would shuffle it.
    """
    passed = rows.where(Compiler().value(parse(filter or "", types_of(table))))
    if keys is not None:
        if table.key is None:
            raise InvalidPayload("the table has no primary key")
        kind = table.key.spark().dataType
        wanted = rows.sparkSession.createDataFrame([(i, k) for i, k in enumerate(keys)], f"__place long, __key {'string' if table.key.type == 'STRING' else 'long'}")
        if len(keys) <= PUSHED_KEYS:
            passed = passed.where(F.col(table.key.name).isin(*set(keys)) if keys else F.lit(False))
        wanted = wanted.withColumn("__key", F.col("__key").try_cast(kind))
        # the list comes with the request: a payload, not a table
        passed = passed.join(F.broadcast(wanted), F.col(table.key.name) == F.col("__key")).orderBy("__place", RID).drop("__place", "__key")
    elif ordered or skip or limit is not None:
        passed = passed.orderBy(RID)
    if skip:
        passed = passed.offset(skip)
    return passed if limit is None else passed.limit(limit)


def knn_join(rows: DataFrame, field: Field, queries: DataFrame, query_id: str, query_vector: str, k: int) -> DataFrame:
    """Extension: the ``k`` nearest rows of each of many dense queries; (query_id, _rid, @distance, rank).

    Exact, every query against every row; ties follow row ids. Both sides are written to the shared
    folder at once; a task takes a file of queries and reads files of rows, so neither side is
    broadcast, and what travels is k rows a query and task. Of equal vectors the k with the smallest
    row ids are enough for any query. Distances to or from a vector that is null, holds null or has
    other dimensions than the field are null, and come last, as null row ids do among equal distances.
    """
    spark, n, size = rows.sparkSession, max(k, 1), field.dimensions
    v = F.col(field.name)
    vector = metrics.normalize_dense(F.col(query_vector)) if field.metric == "COSINE" else F.col(query_vector)
    asked = queries.select(F.col(query_id), vector.alias("__vector")).withColumn("__whole", _whole("__vector", size))
    stored = rows.select(F.col(RID).cast("long").alias(RID), v.alias("__vector")).withColumn("__whole", _whole("__vector", size))
    folder = workspace(spark, "knn")

    copies = Window.partitionBy("__vector").orderBy(F.col(RID).asc_nulls_last())
    once = stored.where("__whole").withColumn("__copy", F.row_number().over(copies)).where(F.col("__copy") <= n)
    row_files = _settle(once.where(F.col(RID).isNotNull()).select(RID, "__vector"), f"{folder}/rows")
    unmeasurable, unnamed = stored.agg(F.count_if(~F.col("__whole")), F.count_if(F.col(RID).isNull())).first()
    count, whole = asked.agg(F.count("*"), F.count_if("__whole")).first()
    parallel = spark.sparkContext.defaultParallelism
    parts = max(-(-whole // blocks.QUERIES), min(2 * parallel, -(-whole // blocks.PIECE)))
    query_files = _settle(asked.where("__whole").select(query_id, "__vector").repartition(parts), f"{folder}/queries") if whole else []
    shards = min(len(row_files), -(-4 * parallel // max(1, len(query_files))))
    tasks = [(q, row_files[i::shards]) for q in query_files for i in range(shards)]
    if unnamed:
        unnamed_files = _settle(once.where(F.col(RID).isNull()).select(RID, "__vector"), f"{folder}/unnamed")
        tasks += [(q, unnamed_files) for q in query_files]

    schema = T.StructType([asked.schema[query_id], T.StructField(RID, T.LongType()), T.StructField(DISTANCE, T.DoubleType())])
    pairs = spark.range(0, len(tasks), 1, max(1, len(tasks))).mapInArrow(blocks.search(tasks, size, n, field.metric, to_arrow_type(schema[0].dataType)), schema)
    nothing = F.lit(None).cast("double").alias(DISTANCE)

    def unmeasured(some: DataFrame, others: DataFrame) -> DataFrame:
        return some.select(query_id).crossJoin(F.broadcast(others.select(RID).orderBy(F.col(RID).asc_nulls_last()).limit(n))).select(query_id, RID, nothing)

    if unmeasurable:
        pairs = pairs.unionByName(unmeasured(asked.where("__whole"), stored.where(~F.col("__whole"))))
    if whole < count:
        pairs = pairs.unionByName(unmeasured(asked.where(~F.col("__whole")), stored))
    order = Window.partitionBy(query_id).orderBy(F.col(f"`{DISTANCE}`").asc_nulls_last(), F.col(RID).asc_nulls_last())
    return pairs.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def _whole(name: str, dimensions: int) -> Column:
    """Whether a vector can be measured."""
    v = F.col(name)
    return v.isNotNull() & (F.size(v) == dimensions) & ~F.coalesce(F.exists(v, lambda x: x.isNull()), F.lit(True))


def _settle(df: DataFrame, uri: str) -> list[str]:
    """Write a table to be read block by block; its files."""
    df.write.option("compression", "uncompressed").option("parquet.enable.dictionary", "false").parquet(uri)
    return df.sparkSession.read.schema(df.schema).parquet(uri).inputFiles()


def fuse(*results: DataFrame, limit: int, constant: int = 60) -> DataFrame:
    """Extension: reciprocal rank fusion of ranked results (each with _rid and @distance); (_rid, score)."""
    parts = [r.select(RID, (1.0 / (F.row_number().over(Window.orderBy(F.col(f"`{DISTANCE}`"), RID)) + constant)).alias("score")) for r in results]
    whole = parts[0]
    for p in parts[1:]:
        whole = whole.unionByName(p)
    return whole.groupBy(RID).agg(F.sum("score").alias("score")).orderBy(F.col("score").desc(), RID).limit(limit)


def distance_column(with_distance: bool) -> Column | None:
    return F.col(f"`{DISTANCE}`") if with_distance else None
