"""Queries of the engine's operators over whole tables, by name, and the SQL they are held against.

Each takes (spark, sf_dir). Distances and sums are rounded, as the order of additions differs.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vectorframe.engine import Engine
from vectorframe.functions import embed, metrics
from vectorframe.operators import ann, mutate, search
from vectorframe.operators.facets import facet
from vectorframe.schema import RID, Field, Table, payload
from vectorframe.sources.files import read_csv
from vectorframe.sources.storage import workspace
from vectorframe.streaming.ingest import ingest

#: Query vector, its sparse form, and rows wanted.
QUERY = [round(math.cos(1.3 * i), 4) for i in range(64)]
SPARSE_QUERY = {"indices": [i for i, x in enumerate(QUERY) if abs(x) > 0.5], "values": [x for x in QUERY if abs(x) > 0.5]}
K = 100
DIGITS = 5

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}

_KINDS = {"tinyint": "TINYINT", "smallint": "SMALLINT", "int": "INT", "bigint": "BIGINT", "float": "FLOAT", "double": "DOUBLE", "string": "STRING", "boolean": "BOOL"}


def query(sql: str | None = None, name: str | None = None):
    """Register a query under its function's name, with the SQL that DuckDB runs on the same tables."""

    def add(f):
        QUERIES[name or f.__name__] = f
        if sql:
            SQL[name or f.__name__] = sql
        return f

    return add


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def described(df: DataFrame, name: str, key: str | None = None) -> Table:
    """The engine's table of a DataFrame's scalar columns."""
    return Table(name, [Field(c, _KINDS[k], c == key) for c, k in df.dtypes if k in _KINDS and c != RID])


def keyed(spark: SparkSession, sf_dir: str, table: str, key: str) -> tuple[DataFrame, Table]:
    df = read(spark, sf_dir, table)
    return df.withColumn(RID, F.col(key).cast("long")), described(df, table, key)


# ---------------------------------------------------------------- nearest rows


def vectors(spark: SparkSession, sf_dir: str, metric: str) -> tuple[DataFrame, Table, Field]:
    """The embeddings as a table with one vector field; lengths differ by label, but for COSINE."""
    df = read(spark, sf_dir, "embeddings")
    v = metrics.normalize_dense(F.col("embedding")) if metric == "COSINE" else F.transform("embedding", lambda x: (x.cast("double") * (F.lit(1.0) + F.col("label") / F.lit(10.0))).cast("float"))
    field = Field("v", "VECTOR_FLOAT", False, 64, metric)
    rows = df.select(F.col("vec_id").alias(RID), "vec_id", "label", v.alias("v"))
    return rows, Table("embeddings", [Field("vec_id", "BIGINT", True), Field("label", "INT"), field]), field


def sparse_vectors(spark: SparkSession, sf_dir: str, metric: str) -> tuple[DataFrame, Table, Field]:
    """The embeddings' entries above 0.15 as sparse vectors."""
    df, e = read(spark, sf_dir, "embeddings"), F.col("embedding")
    at = F.filter(F.sequence(F.lit(0), F.size(e) - 1), lambda i: F.abs(F.get(e, i).cast("double")) > 0.15)
    df = df.withColumn("__at", at).where(F.size("__at") > 0)
    v = F.struct(F.transform("__at", lambda i: i.cast("long")).alias("indices"), F.transform("__at", lambda i: F.get(e, i)).alias("values"))
    field = Field("v", "SPARSE_VECTOR_FLOAT", False, 64, metric)
    return df.select(F.col("vec_id").alias(RID), "vec_id", "label", v.alias("v")), Table("embeddings", [Field("vec_id", "BIGINT", True), Field("label", "INT"), field]), field


def measured(found: DataFrame) -> DataFrame:
    return found.select("vec_id", "label", F.round(F.col(f"`{search.DISTANCE}`"), DIGITS).alias("distance"))


def _list(values: list[float]) -> str:
    return f"[{', '.join(map(str, values))}]::DOUBLE[]"


_SCALED = "list_transform(embedding, lambda x: (x::DOUBLE * (1::DOUBLE + label / 10::DOUBLE))::FLOAT)::DOUBLE[]"
_UNIT = "list_transform(embedding, lambda x: (x::DOUBLE / sqrt(list_inner_product(embedding::DOUBLE[], embedding::DOUBLE[])))::FLOAT)::DOUBLE[]"
_THIN = "list_transform(embedding, lambda x: CASE WHEN abs(x::DOUBLE) > 0.15::DOUBLE THEN x::DOUBLE ELSE 0::DOUBLE END)"


def _distances(metric: str, thin: bool = False) -> str:
    """SQL of (vec_id, label, d) of all embeddings."""
    q = [x if abs(x) > 0.5 or not thin else 0.0 for x in QUERY]
    if metric == "COSINE" and not thin:
        n = math.sqrt(sum(x * x for x in q))
        q = [x / n for x in q]
    v = _THIN if thin else _UNIT if metric == "COSINE" else _SCALED
    d = {
        "EUCLIDEAN": "pow(list_distance(v, q), 2)", "DOT_PRODUCT": "-list_inner_product(v, q)",
        "COSINE": "1 - list_inner_product(v, q) / sqrt(list_inner_product(v, v) * list_inner_product(q, q))" if thin else "1 - list_inner_product(v, q)",
    }[metric]
    where = "WHERE len(list_filter(v, lambda x: x <> 0)) > 0" if thin else ""
    return f"SELECT vec_id, label, {d} AS d FROM (SELECT vec_id, label, {v} AS v, {_list(q)} AS q FROM embeddings) t {where}"


def _top(inner: str, where: str = "", k: int = K) -> str:
    return f"SELECT vec_id, label, round(d, {DIGITS}) AS distance FROM ({inner}) u {where} ORDER BY d, vec_id LIMIT {k}"


for _metric in ("EUCLIDEAN", "COSINE", "DOT_PRODUCT"):
    _low = _metric.lower()

    @query(_top(_distances(_metric)), f"knn_{_low}")
    def _knn(spark, sf_dir, metric=_metric):
        rows, table, field = vectors(spark, sf_dir, metric)
        return measured(search.nearest(rows, table, field, QUERY, K))

    @query(_top(_distances(_metric)), f"knn_{_low}_jvm")
    def _knn_jvm(spark, sf_dir, metric=_metric):
        """The same without Python: higher-order functions."""
        rows, table, field = vectors(spark, sf_dir, metric)
        return measured(search.nearest(rows, table, field, QUERY, K, arrow=False))

    @query(f"SELECT vec_id, label, round(d, {DIGITS}) AS distance FROM ({_distances(_metric)}) u", f"distances_{_low}")
    def _all_distances(spark, sf_dir, metric=_metric):
        """The distance of every row."""
        rows, _, field = vectors(spark, sf_dir, metric)
        return measured(rows.withColumn(search.DISTANCE, metrics.distance(field, QUERY)))

    @query(_top(_distances(_metric, True)), f"knn_sparse_{_low}")
    def _knn_sparse(spark, sf_dir, metric=_metric):
        rows, table, field = sparse_vectors(spark, sf_dir, metric)
        return measured(search.nearest(rows, table, field, SPARSE_QUERY, K))

    @query(f"SELECT vec_id, label, round(d, {DIGITS}) AS distance FROM ({_distances(_metric, True)}) u", f"distances_sparse_{_low}")
    def _all_sparse(spark, sf_dir, metric=_metric):
        rows, _, field = sparse_vectors(spark, sf_dir, metric)
        return measured(rows.withColumn(search.DISTANCE, metrics.distance(field, SPARSE_QUERY)))


@query(_top(_distances("EUCLIDEAN"), "WHERE label <> 3 AND (label * 2 < 14)"))
def knn_filtered(spark, sf_dir):
    """The filter goes first: the full number of rows comes back."""
    rows, table, field = vectors(spark, sf_dir, "EUCLIDEAN")
    return measured(search.nearest(rows, table, field, QUERY, K, "label <> 3 AND (label * 2 < 14)"))


@query(f"SELECT vec_id, label, round(d, {DIGITS}) AS distance FROM ({_distances('COSINE')}) u WHERE d < 1.02 AND label >= 2")
def knn_distance_filter(spark, sf_dir):
    """All rows below a distance; it counts under logical operators, too."""
    rows, table, field = vectors(spark, sf_dir, "COSINE")
    return measured(search.nearest(rows, table, field, QUERY, None, "@distance < 1.02 AND label >= 2"))


@query(f"SELECT vec_id, label, round(d, {DIGITS}) AS distance FROM ({_distances('COSINE')}) u WHERE label >= 2")
def knn_distance_scope(spark, sf_dir):
    """Compatible scope: under a logical operator the distance reads as 0."""
    rows, table, field = vectors(spark, sf_dir, "COSINE")
    return measured(search.nearest(rows, table, field, QUERY, None, "@distance < 0.5 AND label >= 2", compat_distance_scope=True))


@query(f"SELECT vec_id, label, round(d, {DIGITS}) AS distance FROM ({_distances('DOT_PRODUCT')}) u ORDER BY d, vec_id LIMIT 20")
def knn_max_candidates(spark, sf_dir):
    rows, table, field = vectors(spark, sf_dir, "DOT_PRODUCT")
    return measured(search.nearest(rows, table, field, QUERY, K, max_candidates=20))


@query(f"SELECT label, count(*) AS n, round(min(d), {DIGITS}) AS nearest, round(max(d), {DIGITS}) AS farthest FROM ({_distances('EUCLIDEAN')} ORDER BY d, vec_id LIMIT {K}) u GROUP BY label")
def knn_facet(spark, sf_dir):
    """A facet of the rows returned, over their distances."""
    rows, table, field = vectors(spark, sf_dir, "EUCLIDEAN")
    found = search.nearest(rows, table, field, QUERY, K)
    made = facet(found, {"group": ["label"], "aggregate": ["COUNT(1)", "MIN(@distance)", "MAX(@distance)"]}, search.types_of(table), F.col(f"`{search.DISTANCE}`"))
    return made.toDF("label", "n", "nearest", "farthest").select(F.col("label").cast("int"), "n", *[F.round(c, DIGITS).alias(c) for c in ("nearest", "farthest")])


@query(f"""
    WITH e AS (SELECT vec_id, {_SCALED} AS v FROM embeddings)
    SELECT query_id, vec_id, rank FROM (
        SELECT a.vec_id AS query_id, b.vec_id AS vec_id, row_number() OVER (PARTITION BY a.vec_id ORDER BY list_distance(a.v, b.v), b.vec_id) AS rank
        FROM e a, e b) t WHERE rank <= 5""")
def knn_join(spark, sf_dir):
    """Extension: every row as a query against every row."""
    rows, _, field = vectors(spark, sf_dir, "EUCLIDEAN")
    near = search.knn_join(rows, field, rows.select(F.col("vec_id").alias("query_id"), F.col("v").alias("q")), "query_id", "q", 5)
    return near.select("query_id", F.col(RID).alias("vec_id"), F.col("rank").cast("long").alias("rank"))


@query(f"""
    WITH a AS (SELECT vec_id, 1 / (60 + row_number() OVER (ORDER BY d, vec_id))::DOUBLE AS s FROM ({_distances('COSINE')} ORDER BY d, vec_id LIMIT {K}) x),
         b AS (SELECT vec_id, 1 / (60 + row_number() OVER (ORDER BY d, vec_id))::DOUBLE AS s FROM ({_distances('DOT_PRODUCT', True)} ORDER BY d, vec_id LIMIT {K}) x)
    SELECT vec_id, round(score, 7) AS score FROM (SELECT vec_id, sum(s) AS score FROM (SELECT * FROM a UNION ALL SELECT * FROM b) t GROUP BY vec_id) u
    ORDER BY u.score DESC, vec_id LIMIT {K}""")
def knn_fusion(spark, sf_dir):
    """Extension: dense and sparse results fused by reciprocal ranks."""
    rows, table, field = vectors(spark, sf_dir, "COSINE")
    thin, thin_table, thin_field = sparse_vectors(spark, sf_dir, "DOT_PRODUCT")
    found = search.fuse(search.nearest(rows, table, field, QUERY, K), search.nearest(thin, thin_table, thin_field, SPARSE_QUERY, K), limit=K)
    return found.select(F.col(RID).alias("vec_id"), F.round("score", 7).alias("score"))


@query()
def knn_approximate(spark, sf_dir):
    """Inverted file of cells, read in part; approximate, so held against exact search in tests."""
    rows, table, field = vectors(spark, sf_dir, "EUCLIDEAN")
    uri = workspace(spark, "cells")
    centres = ann.build(rows, field, uri)
    near = ann.probe(spark, uri, rows.schema, QUERY, centres)
    return measured(search.nearest(near, table, field, QUERY, K))


@query()
def knn_text(spark, sf_dir):
    """A text query: part names embedded by the built-in provider, nearest to the query's text."""
    model = embed.Registry().get("hashing/64")
    df = read(spark, sf_dir, "part")
    field = Field("v", "VECTOR_FLOAT", False, 64, "COSINE", True)
    # names repeat: each is embedded once
    names = df.select("p_name").distinct().withColumn("v", embed.embed_column(model, F.col("p_name"), 64))
    rows = df.select(F.col("p_partkey").alias(RID), "p_partkey", "p_name").join(names, "p_name")
    table = Table("part", [Field("p_partkey", "BIGINT", True), Field("p_name", "STRING"), field])
    found = search.nearest(rows, table, field, embed.embed_query(model, "blue widget", 64), K)
    return found.select("p_partkey", "p_name", F.round(F.col(f"`{search.DISTANCE}`"), DIGITS).alias("distance"))


# ---------------------------------------------------------------- filters

_KEYS = {"lineitem": ["l_orderkey", "l_linenumber", "l_quantity", "l_extendedprice"], "orders": ["o_orderkey", "o_orderstatus", "o_totalprice"], "part": ["p_partkey", "p_name"], "events": ["event_id", "flag"]}
_FROM = {"events": "(SELECT *, value > 50 AS flag FROM events) events"}


def filtered(spark: SparkSession, sf_dir: str, table: str, text: str) -> DataFrame:
    """All rows of a table that pass a filter."""
    df = read(spark, sf_dir, table)
    if table == "events":
        df = df.withColumn("flag", F.col("value") > 50)
    found = search.lookup(df, described(df, table), filter=text)  # no order, so no row ids: the filter reaches the scan
    return found.select(*_KEYS[table])


_FILTERS = [
    ("arithmetic", "lineitem", "l_quantity * 2 - l_discount + l_tax > 90 + l_linenumber", None),
    ("precedence", "lineitem", "(l_quantity + 2) * 3 - l_linenumber * 2 >= l_quantity", None),
    ("divide", "lineitem", "l_extendedprice / (l_linenumber - 1) > 20000", "CASE WHEN l_linenumber = 1 THEN l_extendedprice > 0 ELSE l_extendedprice / (l_linenumber - 1)::DOUBLE > 20000 END"),
    ("integer_divide", "lineitem", "l_linenumber / 2 = 1.5", "l_linenumber::DOUBLE / 2 = 1.5"),
    ("remainder", "lineitem", "l_quantity % 5 >= 2", None),
    ("remainder_zero", "lineitem", "l_quantity % (l_linenumber - 3) <> 1", "CASE WHEN l_linenumber = 3 THEN true ELSE l_quantity % (l_linenumber - 3)::DOUBLE <> 1 END"),
    ("signed", "lineitem", "l_quantity - 30 > -5 AND (l_tax <= +0.04)", "l_quantity - 30 > -5 AND l_tax <= 0.04::DOUBLE"),
    ("equal", "lineitem", "l_linenumber = 3", None),
    ("not_equal", "lineitem", "l_returnflag <> 'R'", None),
    ("less", "lineitem", "l_quantity < 10", None),
    ("less_equal", "lineitem", "l_discount <= 0.05", "l_discount <= 0.05::DOUBLE"),
    ("greater", "lineitem", "l_extendedprice > 50000.5", None),
    ("greater_equal", "lineitem", "l_linenumber >= 4", None),
    ("concat", "lineitem", "l_returnflag + l_linestatus = 'RF'", "concat(l_returnflag, l_linestatus) = 'RF'"),
    ("and", "orders", "o_orderstatus = 'F' AND o_totalprice > 200000", None),
    ("or", "orders", "o_orderstatus = 'P' OR o_totalprice > 300000", None),
    ("or_and", "orders", "o_orderstatus = 'F' OR o_orderstatus = 'O' AND o_totalprice > 200000", "(o_orderstatus = 'F' OR o_orderstatus = 'O') AND o_totalprice > 200000"),
    ("not", "orders", "NOT o_orderstatus = 'F' AND o_totalprice < 50000", "(NOT o_orderstatus = 'F') AND o_totalprice < 50000"),
    ("and_not", "orders", "o_totalprice < 50000 AND (NOT o_orderstatus = 'F')", "o_totalprice < 50000 AND NOT o_orderstatus = 'F'"),
    ("in", "orders", "o_orderpriority IN ('1-URGENT', '2-HIGH')", None),
    ("not_in", "orders", "o_orderpriority NOT IN ('1-URGENT', '2-HIGH')", None),
    ("in_number_field_mix", "orders", "o_orderpriority IN ('5-LOW') AND (o_custkey <= 700)", None),
    ("like", "part", "p_name LIKE '%e%t'", None),
    ("like_one", "part", "p_name LIKE '_l__ %'", None),
    ("like_exact", "part", "p_type LIKE 'SMALL'", None),
    ("like_any", "part", "p_type LIKE '%'", "true"),
    ("like_expression", "part", "p_name LIKE '%' + 'ring'", "p_name LIKE '%ring'"),
    ("not_like", "part", "p_name NOT LIKE 'red%'", None),
    ("bool", "events", "flag = TRUE", "flag"),
    ("bool_field", "events", "flag", None),
    ("not_bool", "events", "NOT flag OR event_type = 'click'", "(NOT flag) OR event_type = 'click'"),
    ("empty", "part", "", "true"),
]
for _name, _table, _text, _where in _FILTERS:

    @query(f"SELECT {', '.join(_KEYS[_table])} FROM {_FROM.get(_table, _table)} WHERE {_where or _text}", f"filter_{_name}")
    def _filter(spark, sf_dir, table=_table, text=_text):
        return filtered(spark, sf_dir, table, text)


def places(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, Table]:
    """Customers at places told from their keys."""
    df = read(spark, sf_dir, "customer")
    lat, lon = (F.col("c_custkey") % 181 - 90).cast("double"), ((F.col("c_custkey") * 7) % 361 - 180).cast("double")
    rows = df.select(F.col("c_custkey").alias(RID), "c_custkey", "c_name", F.struct(lat.alias("latitude"), lon.alias("longitude")).alias("at"))
    return rows, Table("customer", [Field("c_custkey", "BIGINT", True), Field("c_name", "STRING"), Field("at", "GEO_POINT")])


_PLACES = "(SELECT *, (c_custkey % 181 - 90)::DOUBLE AS lat, ((c_custkey * 7) % 361 - 180)::DOUBLE AS lon FROM customer) t"


def _km(lat: float, lon: float) -> str:
    a = f"(pow(sin(radians({lat} - lat) / 2), 2) + cos(radians(lat)) * cos(radians({lat})) * pow(sin(radians({lon} - lon) / 2), 2))"
    return f"2 * 6371.0::DOUBLE * atan2(sqrt({a}), sqrt(1 - {a}))"


@query(f"SELECT c_custkey, c_name, lat AS latitude, lon AS longitude FROM {_PLACES} WHERE {_km(34.0, -118.0)} <= 2000.5")
def nearby(spark, sf_dir):
    rows, table = places(spark, sf_dir)
    return search.lookup(rows, table, filter="NEARBY(at, 34, -118, 2000.5)").select("c_custkey", "c_name", "at.latitude", "at.longitude")


@query(f"SELECT c_custkey FROM {_PLACES} WHERE ({_km(-17.5, 179.0)} <= 4000.5 OR {_km(89.0, 10.0)} <= 900.5) AND c_name <> 'x'")
def nearby_edges(spark, sf_dir):
    """Circles across the date line and a pole, under logical operators."""
    rows, table = places(spark, sf_dir)
    return search.lookup(rows, table, filter="NEARBY(at, -17.5, 179, 4000.5) OR NEARBY(at, 89, 10, 900.5) AND c_name <> 'x'").select("c_custkey")


# ---------------------------------------------------------------- get


@query("SELECT o_orderkey, o_custkey, o_totalprice FROM orders WHERE o_totalprice > 1000 ORDER BY o_orderkey LIMIT 500 OFFSET 250")
def get_skip_limit(spark, sf_dir):
    rows, table = keyed(spark, sf_dir, "orders", "o_orderkey")
    return search.project(search.lookup(rows, table, filter="o_totalprice > 1000", skip=250, limit=500), table, ["o_orderkey", "o_custkey", "o_totalprice"])


@query("SELECT c_custkey, c_name, c_acctbal FROM (VALUES (3), (1), (3), (99999999), (2), (57)) k(key) JOIN customer ON c_custkey = key")
def get_keys(spark, sf_dir):
    """Rows of a key list: in its order, repeats repeated, misses left out."""
    rows, table = keyed(spark, sf_dir, "customer", "c_custkey")
    return search.project(search.lookup(rows, table, [3, 1, 3, 99999999, 2, 57]), table, ["c_custkey", "c_name", "c_acctbal"])


@query("SELECT c_custkey, c_name, c_acctbal FROM (VALUES (3), (1), (3), (2), (57)) k(key) JOIN customer ON c_custkey = key WHERE c_acctbal > 2000")
def get_keys_filter(spark, sf_dir):
    rows, table = keyed(spark, sf_dir, "customer", "c_custkey")
    return search.project(search.lookup(rows, table, [3, 1, 3, 2, 57], "c_acctbal > 2000"), table, ["c_custkey", "c_name", "c_acctbal"])


@query("SELECT event_id, props FROM events")
def get_json(spark, sf_dir):
    """A scan of a JSON field, as its text."""
    df = read(spark, sf_dir, "events")
    table = Table("events", [Field("event_id", "BIGINT", True), Field("props", "JSON")])
    return search.project(search.lookup(df.withColumn(RID, F.col("event_id")), table), table, ["event_id", "props"])


# ---------------------------------------------------------------- facets


def _facet(table: str, group: list[str], aggregates: list[str], names: list[str], casts: dict[str, str] | None = None, extensions: bool = False):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        df = read(spark, sf_dir, table)
        made = facet(df, {"group": group, "aggregate": aggregates}, search.types_of(described(df, table)), extensions=extensions).toDF(*names)
        return made.select(*[F.round(c, 2).alias(c) if k == "double" else F.col(c).cast((casts or {}).get(c, k)).alias(c) for c, k in made.dtypes])

    return run


_FACETS = {
    "sum": (("lineitem", ["l_returnflag"], ["SUM(l_quantity)", "SUM(l_extendedprice * (1 - l_discount))"], ["flag", "quantity", "revenue"]), "SELECT l_returnflag AS flag, round(sum(l_quantity), 2) AS quantity, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue FROM lineitem GROUP BY 1"),
    "count": (("events", ["event_type"], ["COUNT(1)", "count(value)"], ["kind", "n", "m"]), "SELECT event_type AS kind, count(*) AS n, count(*) AS m FROM events GROUP BY 1"),
    "min": (("lineitem", ["l_linenumber"], ["MIN(l_extendedprice)", "MIN(l_orderkey)"], ["line", "price", "key"]), "SELECT l_linenumber::BIGINT AS line, round(min(l_extendedprice), 2) AS price, min(l_orderkey) AS key FROM lineitem GROUP BY 1"),
    "max": (("lineitem", ["l_linenumber"], ["MAX(l_extendedprice)", "MAX(l_orderkey)"], ["line", "price", "key"]), "SELECT l_linenumber::BIGINT AS line, round(max(l_extendedprice), 2) AS price, max(l_orderkey) AS key FROM lineitem GROUP BY 1"),
    "global": (("lineitem", [], ["COUNT(1)", "SUM(l_linenumber)", "MAX(l_tax)"], ["n", "lines", "tax"]), "SELECT count(*) AS n, sum(l_linenumber)::BIGINT AS lines, round(max(l_tax), 2) AS tax FROM lineitem"),
    "expression": (("lineitem", ["l_linenumber / 2"], ["COUNT(1)", "SUM(l_linenumber / 2)"], ["half", "n", "halves"]), "SELECT trunc(l_linenumber::DOUBLE / 2)::BIGINT AS half, count(*) AS n, trunc(sum(l_linenumber::DOUBLE / 2))::BIGINT AS halves FROM lineitem GROUP BY 1"),
    "double_key": (("lineitem", ["l_discount"], ["COUNT(1)"], ["discount", "n"]), "SELECT round(l_discount, 2) AS discount, count(*) AS n FROM lineitem GROUP BY 1"),
    "bool_key": (("lineitem", ["l_quantity > 25"], ["COUNT(1)", "MIN(l_quantity)"], ["large", "n", "least"]), "SELECT l_quantity > 25 AS large, count(*) AS n, round(min(l_quantity), 2) AS least FROM lineitem GROUP BY 1"),
    "concat_key": (("lineitem", ["l_returnflag + l_linestatus"], ["COUNT(1)"], ["both", "n"]), "SELECT concat(l_returnflag, l_linestatus) AS both, count(*) AS n FROM lineitem GROUP BY 1"),
    "no_distance": (("lineitem", ["l_returnflag"], ["SUM(@distance)"], ["flag", "d"]), "SELECT l_returnflag AS flag, 0::DOUBLE AS d FROM lineitem GROUP BY 1"),
    "several_keys": (("lineitem", ["l_returnflag", "l_linestatus"], ["AVG(l_quantity)"], ["flag", "status", "mean"], None, True), "SELECT l_returnflag AS flag, l_linestatus AS status, round(avg(l_quantity), 2) AS mean FROM lineitem GROUP BY 1, 2"),
}
for _name, (_how, _text) in _FACETS.items():
    query(_text, f"facet_{_name}")(_facet(*_how))


@query("SELECT o_orderstatus AS status, count(*) AS n, round(sum(o_totalprice), 2) AS price FROM (SELECT * FROM orders ORDER BY o_orderkey LIMIT 1000 OFFSET 10) t GROUP BY 1")
def facet_after_limit(spark, sf_dir):
    """Facets cover the rows returned, not all that match."""
    rows, table = keyed(spark, sf_dir, "orders", "o_orderkey")
    found = search.lookup(rows, table, skip=10, limit=1000)
    made = facet(found, {"group": ["o_orderstatus"], "aggregate": ["COUNT(1)", "SUM(o_totalprice)"]}, search.types_of(table))
    return made.toDF("status", "n", "price").withColumn("price", F.round("price", 2))


@query("SELECT l_returnflag AS flag, count(*) AS n FROM lineitem WHERE l_quantity > 1000000 GROUP BY 1")
def facet_empty(spark, sf_dir):
    df = read(spark, sf_dir, "lineitem")
    table = described(df, "lineitem")
    none = search.lookup(df, table, filter="l_quantity > 1000000")
    return facet(none, {"group": ["l_returnflag"], "aggregate": ["COUNT(1)"]}, search.types_of(table)).toDF("flag", "n")


# ---------------------------------------------------------------- mutations


def batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows for the customer table: suppliers under their own keys (old ones), again with another balance (repeats in the batch), and under new keys."""
    s = read(spark, sf_dir, "supplier").select("s_suppkey", "s_name", "s_acctbal")

    def part(place: int, key: Column, balance: Column) -> DataFrame:
        return s.select((F.col("s_suppkey") + F.lit(place)).cast("long").alias(RID), key.alias("c_custkey"), F.col("s_name").alias("c_name"), balance.alias("c_acctbal"))

    k, b = F.col("s_suppkey"), F.col("s_acctbal")
    return part(0, k, b).unionByName(part(10**8, k, b + 1)).unionByName(part(2 * 10**8, k + 10**9, b)).unionByName(part(3 * 10**8, k + 10**9, b + 2))


_BATCH = "(SELECT s_suppkey AS k, s_name AS n, s_acctbal AS b, 0 AS p FROM supplier UNION ALL SELECT s_suppkey, s_name, s_acctbal + 1, 1 FROM supplier UNION ALL SELECT s_suppkey + 1000000000, s_name, s_acctbal, 2 FROM supplier UNION ALL SELECT s_suppkey + 1000000000, s_name, s_acctbal + 2, 3 FROM supplier)"


def customers(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, Table]:
    df = read(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_acctbal")
    return df.withColumn(RID, F.col("c_custkey")), described(df, "customer", "c_custkey")


_OUT = ["c_custkey", "c_name", "c_acctbal"]


@query(f"""SELECT c_custkey, c_name, round(c_acctbal, 2) AS c_acctbal FROM customer UNION ALL
    SELECT k, n, round(b, 2) FROM (SELECT *, row_number() OVER (PARTITION BY k ORDER BY p) AS r FROM {_BATCH} s) t WHERE r = 1 AND k NOT IN (SELECT c_custkey FROM customer)""")
def insert(spark, sf_dir):
    """Keys that the table has are skipped; of repeats in the batch the first counts."""
    base, table = customers(spark, sf_dir)
    out = base.unionByName(mutate.new_rows(base, batch(spark, sf_dir), "c_custkey"))
    return out.select("c_custkey", "c_name", F.round("c_acctbal", 2).alias("c_acctbal"))


@query(f"""SELECT c_custkey, c_name, round(c_acctbal, 2) AS c_acctbal FROM customer WHERE c_custkey NOT IN (SELECT k FROM {_BATCH} s) UNION ALL
    SELECT k, n, round(b, 2) FROM (SELECT *, row_number() OVER (PARTITION BY k ORDER BY p DESC) AS r FROM {_BATCH} s) t WHERE r = 1""")
def upsert(spark, sf_dir):
    """Rows of known keys are replaced; of repeats in the batch the last counts."""
    base, table = customers(spark, sf_dir)
    return mutate.upserted(base, batch(spark, sf_dir), "c_custkey").select("c_custkey", "c_name", F.round("c_acctbal", 2).alias("c_acctbal"))


def _without(base: DataFrame, gone: DataFrame) -> DataFrame:
    return base.join(gone, RID, "left_anti").select(*_OUT)


@query("SELECT c_custkey, c_name, c_acctbal FROM customer WHERE c_custkey NOT IN (5, 17, 40, 99999999)")
def delete_keys(spark, sf_dir):
    base, table = customers(spark, sf_dir)
    return _without(base, mutate.deleted(base, table, [5, 17, 17, 40, 99999999], ""))


@query("SELECT c_custkey, c_name, c_acctbal FROM customer WHERE NOT (c_acctbal < 0 OR c_name LIKE '%7')")
def delete_filter(spark, sf_dir):
    base, table = customers(spark, sf_dir)
    return _without(base, mutate.deleted(base, table, None, "c_acctbal < 0 OR c_name LIKE '%7'"))


@query("SELECT c_custkey, c_name, c_acctbal FROM customer WHERE NOT (c_custkey IN (5, 17, 40) AND c_acctbal > 3000)")
def delete_keys_filter(spark, sf_dir):
    base, table = customers(spark, sf_dir)
    return _without(base, mutate.deleted(base, table, [5, 17, 40], "c_acctbal > 3000"))


_PREPARED = [7, 10**9, 3, 10**9 + 1, *range(10**6, 10**6 + 30), 1, 2, 10**9 + 2]


@query(f"""
    WITH k AS (SELECT unnest(generate_series(0, {len(_PREPARED) - 1})) AS place, unnest({_PREPARED}) AS key),
         w AS (SELECT unnest(generate_series(0, {-(-len(_PREPARED) // 32) * 32 - 1})) AS place)
    SELECT (w.place // 32)::BIGINT AS word, sum(CASE WHEN c.c_custkey IS NOT NULL THEN 0 ELSE 1::BIGINT << (w.place % 32)::INT END)::BIGINT AS mask
    FROM w LEFT JOIN k ON w.place = k.place LEFT JOIN customer c ON c.c_custkey = k.key GROUP BY 1""")
def insert_prepare(spark, sf_dir):
    """Masks of a key list: bit i of a word is set if key i is new."""
    return mutate.new_key_masks(read(spark, sf_dir, "customer"), "c_custkey", _PREPARED, "long")


@query("SELECT vec_id, label FROM embeddings WHERE label <> 3")
def insert_invalid(spark, sf_dir):
    """Rows whose vectors have the wrong length are skipped."""
    df = read(spark, sf_dir, "embeddings")
    v = F.when(F.col("label") == 3, F.slice("embedding", 1, 63)).otherwise(F.col("embedding"))
    table = Table("e", [Field("vec_id", "BIGINT"), Field("label", "INT"), Field("v", "VECTOR_FLOAT", False, 64, "COSINE")])
    return mutate.checked(df.select("vec_id", "label", v.alias("v")), table).select("vec_id", "label")


# ---------------------------------------------------------------- tables on disk


def _engine(spark: SparkSession) -> Engine:
    engine = Engine(spark)
    engine.load_db("d", workspace(spark, "database"))
    return engine


@query(f"""
    SELECT c_custkey, c_name, round(c_acctbal, 2) AS c_acctbal FROM (
        SELECT c_custkey, c_name, c_acctbal FROM customer WHERE c_custkey NOT IN (SELECT k FROM {_BATCH} s) UNION ALL
        SELECT k, n, b FROM (SELECT *, row_number() OVER (PARTITION BY k ORDER BY p DESC) AS r FROM {_BATCH} s) t WHERE r = 1) u
    WHERE NOT c_acctbal < 0""")
def table_lifecycle(spark, sf_dir):
    """A table on disk: created, filled in bulk, upserted, deleted from, dumped, loaded again and read."""
    engine = _engine(spark)
    engine.create_table("d", payload("c", c_custkey="BIGINT key", c_name="STRING", c_acctbal="DOUBLE", v="VECTOR_FLOAT 2"))
    v = F.array(F.col("c_acctbal").cast("float"), F.lit(1.0).cast("float")).alias("v")
    base, more = customers(spark, sf_dir)[0].select(*_OUT, v), batch(spark, sf_dir)
    engine.insert_frame("d", "c", base)
    # the batch has the order of its ids: the bulk form numbers rows as it reads them
    engine.insert_frame("d", "c", mutate.first_of_batch(more, "c_custkey", last=True).select(*_OUT, v), upsert=True)
    engine.delete("d", "c", filter="c_acctbal < 0")
    copy = workspace(spark, "copy")
    engine.dump_db("d", copy)
    engine.unload_db("d")
    engine.load_db("e", copy)
    return engine.get("e", "c", response=_OUT).withColumn("c_acctbal", F.round("c_acctbal", 2))


@query("SELECT n_nationkey, n_name FROM nation")
def load_csv(spark, sf_dir):
    uri = workspace(spark, "csv")
    df = read(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    df.withColumn("v", F.lit("[1.0, 2.0]")).write.csv(uri, header=True)
    table = Table("nation", [Field("n_nationkey", "INT", True), Field("n_name", "STRING"), Field("v", "VECTOR_FLOAT", False, 2)])
    return mutate.checked(read_csv(spark, uri, table), table).select("n_nationkey", "n_name")


@query("SELECT label, count(*) AS n, min(vec_id) AS first, max(vec_id) AS last FROM embeddings GROUP BY label")
def stream_ingest(spark, sf_dir):
    """A stream of micro-batches into a table, read after it; a batch told twice counts once."""
    engine = _engine(spark)
    engine.create_table("d", payload("e", vec_id="BIGINT key", label="INT", embedding="VECTOR_FLOAT 64 COSINE"))
    df = read(spark, sf_dir, "embeddings")
    stream = spark.readStream.schema(df.schema).option("recursiveFileLookup", "true").parquet(f"{sf_dir}/embeddings*.parquet")
    ingest(engine, "d", "e", stream, workspace(spark, "stream")).awaitTermination()
    made = facet(engine.table("d", "e"), {"group": ["label"], "aggregate": ["COUNT(1)", "MIN(vec_id)", "MAX(vec_id)"]}, {"label": "INT", "vec_id": "BIGINT"})
    return made.toDF("label", "n", "first", "last").withColumn("label", F.col("label").cast("int"))
