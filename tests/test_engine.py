"""Tables on disk: reads, mutations, logs, snapshots, approximate search, the JSON interface and streams."""

from __future__ import annotations

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from vectorframe import Api, Engine
from vectorframe.errors import Conflict, EngineError, InvalidExpr, InvalidName, InvalidPayload, InvalidRecord, NotFound, NotLeader, TableExists, TableNotFound
from vectorframe.functions import embed, metrics
from vectorframe.operators import ann
from vectorframe.operators.facets import facet
from vectorframe.schema import Field, payload
from vectorframe.streaming.ingest import changes, ingest

# hundredths of the vectors of five cities, and of the query; ids from the nearest on
CITIES = {1: ("Berlin", "05 61 76 74"), 2: ("London", "19 81 75 11"), 3: ("Moscow", "36 55 47 94"), 4: ("San Francisco", "18 01 85 80"), 5: ("Shanghai", "24 18 22 44")}
ORDERS = {"EUCLIDEAN": [3, 1, 5, 4, 2], "DOT_PRODUCT": [3, 1, 4, 2, 5], "COSINE": [3, 5, 1, 4, 2]}


def hundredths(text):
    return [int(x) / 100 for x in text.split()]


QUERY = hundredths("35 55 47 94")


@pytest.fixture
def engine(spark, tmp_path):
    e = Engine(spark)
    e.load_db("db", str(tmp_path / "db"))
    return e


def whole(values):
    """A sparse vector with every index."""
    return {"indices": list(range(len(values))), "values": values}


def cities(engine, sparse=False):
    kind = "SPARSE_VECTOR_FLOAT" if sparse else "VECTOR_FLOAT"
    engine.create_table("db", payload("c", ID="INT key", Doc="STRING", **{m: f"{kind} 4 {m}" for m in ORDERS}))
    form = whole if sparse else list
    return [{"ID": i, "Doc": CITIES[i][0], **{m: form(hundredths(CITIES[i][1])) for m in ORDERS}} for i in (1, 2, 3, 4, 5, 1)]


@pytest.mark.parametrize("sparse", [False, True])
def test_golden_orders(engine, sparse):
    records = cities(engine, sparse)
    assert engine.insert("db", "c", records) == {"inserted": 5, "skipped": 1}
    query = whole(QUERY) if sparse else QUERY
    for metric, order in ORDERS.items():
        rows = engine.query("db", "c", query, metric, limit=6, response=["ID", "Doc"], with_distance=True).collect()
        assert [r.ID for r in rows] == order and rows[0].Doc == "Moscow"
        assert [r["@distance"] for r in rows] == sorted(r["@distance"] for r in rows)
    assert [r.ID for r in engine.query("db", "c", query, "EUCLIDEAN", limit=6, filter="ID <= 2", response=["ID"]).collect()] == [1, 2]
    with pytest.raises(EngineError):
        engine.query("db", "c", QUERY if sparse else {"indices": [0], "values": [1.0]}, "COSINE")
    with pytest.raises(InvalidPayload):  # three vector fields, none named
        engine.query("db", "c", query)
    for bad in ("Doc", "nothing"):
        with pytest.raises(EngineError):
            engine.query("db", "c", query, bad)
    with pytest.raises(EngineError):
        engine.query("db", "c", query, "COSINE", response=["nothing"])
    assert engine.delete("db", "c", [1, 2, 3, 4, 77]) == {"deleted": 4}
    assert [r.Doc for r in engine.query("db", "c", query, "COSINE", limit=6, response=["Doc"]).collect()] == ["Shanghai"]
    assert engine.statistics("db") == [{"tableName": "c", "totalRecords": 1}]


def test_half_circle_through_rebuild(engine):
    n = 2000
    engine.create_table("db", payload("t", ID="INT key", v="VECTOR_FLOAT 2 COSINE"))
    order = list(range(n))
    random.Random(3).shuffle(order)
    records = [{"ID": i, "v": [math.cos(i * math.pi / n), math.sin(i * math.pi / n)]} for i in order]

    def best(**more):
        return [r.ID for r in engine.query("db", "t", [1.0, 0.0], limit=100, response=["ID"], **more).collect()]

    engine.insert("db", "t", records[: n // 2])
    assert best() == sorted(order[: n // 2])[:100]
    engine.rebuild("db")
    engine.insert("db", "t", records[n // 2 :])
    assert best() == list(range(100))
    near = best(approximate=True)  # cells of the rebuild and the rows since
    assert near == list(range(100))
    engine.delete("db", "t", filter="ID < 10")
    assert best() == list(range(10, 110)) and not set(best(approximate=True)) & set(range(10))
    engine.rebuild("db", "t")
    assert best() == list(range(10, 110))
    assert [r.ID for r in engine.query("db", "t", [1.0, 0.0], limit=10, filter="ID < 15 AND @distance < 0.5").collect()] == list(range(10, 15))


def test_invalid_sparse_rows(engine):
    engine.create_table("db", payload("s", ID="INT key", v="SPARSE_VECTOR_FLOAT 4"))
    bad = [([0, 1], [1.0]), ([1, 0], [1.0, 1.0]), ([0, 4], [1.0, 1.0]), ([-1, 2], [1.0, 1.0]), ([1, 3], [0.5, 0.5]), ([], [])]
    records = [{"ID": i + 1, "v": {"indices": a, "values": b}} for i, (a, b) in enumerate(bad)]
    assert engine.insert("db", "s", records) == {"inserted": 1, "skipped": 5}
    assert [r.ID for r in engine.get("db", "s").collect()] == [5]


def test_dense_and_sparse_metrics_against_numpy(spark):
    rng = np.random.default_rng(1)
    x, q = rng.normal(size=(40, 40)).astype(np.float32), rng.normal(size=40)
    x[3] = 0
    rows = spark.createDataFrame([(i, [float(y) for y in v]) for i, v in enumerate(x)], "i int, v array<float>")
    unit = x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-20)
    want = {"EUCLIDEAN": ((x - q) ** 2).sum(axis=1), "DOT_PRODUCT": -x @ q, "COSINE": 1 - unit @ q / np.linalg.norm(q)}
    for metric, expected in want.items():
        field = Field("v", "VECTOR_FLOAT", False, 40, metric)
        stored = rows.withColumn("v", metrics.normalize_dense(F.col("v"))) if metric == "COSINE" else rows
        for arrow in (False, True):
            got = [r.d for r in stored.select("i", metrics.distance(field, list(q), arrow).alias("d")).orderBy("i").collect()]
            np.testing.assert_allclose(got, expected, atol=2e-5)
        assert metric != "COSINE" or got[3] == 1.0  # a zero vector
        dot = [(i, {"indices": np.flatnonzero(np.abs(v) > 1).tolist(), "values": [float(y) for y in v[np.abs(v) > 1]]}) for i, v in enumerate(x)]
        thin = spark.createDataFrame(dot, "i int, v struct<indices:array<bigint>,values:array<float>>")
        w = np.where(np.abs(x) > 1, x, 0).astype(float)
        n = np.linalg.norm(w, axis=1)
        with np.errstate(invalid="ignore"):
            expected = {"EUCLIDEAN": ((w - q) ** 2).sum(axis=1), "DOT_PRODUCT": -w @ q, "COSINE": 1 - w @ q / n / np.linalg.norm(q)}[metric]
        d = metrics.distance(Field("v", "SPARSE_VECTOR_FLOAT", False, 40, metric), {"indices": list(range(40)), "values": list(q)})
        np.testing.assert_allclose([r.d for r in thin.select("i", d.alias("d")).orderBy("i").collect()], expected, atol=2e-5)


def test_recall_of_cells(spark, sf_dir):
    df = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select(F.col("vec_id").alias("_rid"), "embedding").cache()
    uri = f"{spark.conf.get('spark.checkpoint.dir')}/recall-cells"
    centres = ann.build(df, Field("embedding", "VECTOR_FLOAT", False, 64), uri)
    x = {r._rid: np.array(r.embedding) for r in df.collect()}
    ids = np.array(sorted(x))
    m = np.stack([x[i] for i in ids])
    hits = []
    for q in ids[:12]:
        near = ann.probe(spark, uri, df.schema, x[q].tolist(), centres).select("_rid").collect()
        exact = ids[np.argsort(((m - x[q]) ** 2).sum(axis=1), kind="stable")[:10]]
        hits.append(len({r._rid for r in near} & set(exact.tolist())) / 10)
    assert np.mean(hits) >= 0.9


FULL = payload("m", k="string key", t="TinyInt", f="FLOAT", b="BOOL", j="JSON", at="GEO_POINT", v="VECTOR_DOUBLE 2 cosine")


def record(k, t=1, f=0.5, b=True, j=None, at=None, v=(3.0, 4.0)):
    return {"k": k, "t": t, "f": f, "b": b, "j": j, "at": at or {"latitude": 1.0, "longitude": 2.0}, "v": list(v)}


def test_coercion_upsert_prepare(engine):
    engine.create_table("db", FULL)
    assert engine.insert("db", "m", [record("a", t=300, j={"x": [1, None]}), record("b", t="no", f=True, b=1, at={"latitude": 99, "longitude": -999}), record("c", v=[1.0])]) == {"inserted": 2, "skipped": 1}
    a, b = sorted(engine.get("db", "m").collect(), key=lambda r: r.k)
    assert a.t == 44 and b.t == 0 and b.f == 0.0 and b.b is False and (b["at"].latitude, b["at"].longitude) == (90.0, -180.0)
    assert a.v == pytest.approx([0.6, 0.8])  # stored, and returned, with unit length
    assert a.j == '{"x": [1, null]}'
    with pytest.raises(InvalidRecord):  # one bad record voids the batch
        engine.insert("db", "m", [record("z"), {"k": "y"}])
    assert engine.insert("db", "m", [record("a", t=5), record("d"), record("d", t=9)], upsert=True) == {"inserted": 2, "skipped": 1}
    assert {r.k: r.t for r in engine.get("db", "m").collect()} == {"a": 5, "b": 0, "d": 9}
    assert engine.insert_prepare("db", "m", ["a", "q", "d", "r"]) == {"capacity": None, "recordNumber": 3, "masks": [0xFFFFFFFF - 0b0101]}
    assert [r.k for r in engine.get("db", "m", ["d", "zz", "a", "d"]).collect()] == ["d", "a", "d"]
    assert [r.k for r in engine.get("db", "m", skip=1, limit=1, response=["k"]).collect()] == ["a"]
    assert engine.get("db", "m", limit=0).count() == 0 and engine.get("db", "m", skip=9).count() == 0
    assert engine.delete("db", "m", ["a", "b"], "t > 1") == {"deleted": 1}
    for keys, text in (([1], ""), (None, ""), ([], "")):
        with pytest.raises(InvalidPayload):
            engine.delete("db", "m", keys, text)
    assert engine.delete("db", "m", filter="b = FALSE") == {"deleted": 1}
    assert [r.k for r in engine.get("db", "m", filter="NEARBY(at, 1, 2, 1)").collect()] == ["d"]


def test_log_replay_dump_and_catalog(engine, spark, tmp_path):
    engine.create_table("db", FULL)
    engine.insert("db", "m", [record("a"), record("b")])
    s = engine.databases["db"].get("m")
    # mutations that were logged before the process ended
    log = engine.databases["db"].log(s)
    log.append(s.wal_id + 1, "INSERT", [record("c")])
    log.append(s.wal_id + 2, "UPSERT", [record("a", t=7)])
    log.append(s.wal_id + 3, "DELETE", ["b"])
    log.append(s.wal_id + 4, "DELETE", {"primaryKeys": None, "filter": "t = 99"})
    log.append(s.wal_id + 5, "INSERT", [{"k": "broken"}])
    path = engine.databases["db"].path
    again = Engine(spark)
    again.load_db("other", path)
    assert {r.k: r.t for r in again.get("other", "m").collect()} == {"a": 7, "c": 1}
    third = Engine(spark)  # all of it is in the catalog now
    third.load_db("x", path)
    assert third.statistics("x") == [{"tableName": "m", "totalRecords": 2}]
    third.rebuild("x")
    third.dump_db("x", str(tmp_path / "copy"))
    third.load_db("y", str(tmp_path / "copy"))
    assert third.get("y", "m").count() == 2
    assert changes(spark, f"file://{path}/0/wal").isStreaming
    with pytest.raises(EngineError):
        third.load_db("y", str(tmp_path / "elsewhere"))
    third.release_db("y")
    third.unload_db("y")
    with pytest.raises(NotFound):
        third.get("y", "m")
    third.drop_table("x", "m")
    with pytest.raises(TableNotFound):
        third.get("x", "m")
    assert third.list_tables("x") == []


@pytest.mark.parametrize("change, why", [
    ({"name": "1x"}, InvalidName), ({"name": None}, InvalidName), ({"fields": []}, EngineError), ({"fields": [{"name": "v", "dataType": "VECTOR_FLOAT", "dimensions": 0}]}, EngineError),
    ({"fields": [{"name": "v", "dataType": "VECTOR_FLOAT"}]}, InvalidPayload), ({"fields": [{"name": "v", "dataType": "VECTOR_FLOAT", "dimensions": 2, "metricType": "L7"}]}, EngineError),
    ({"fields": [*FULL["fields"], {"name": "k"}]}, InvalidName), ({"fields": [*FULL["fields"], {"name": "k2", "primaryKey": True}]}, InvalidPayload),
    ({"fields": [{"name": "x", "dataType": "BOOL", "primaryKey": True}, FULL["fields"][-1]]}, EngineError), ({"fields": [{"name": "x", "dataType": "DECIMAL"}, FULL["fields"][-1]]}, EngineError),
    ({"indices": [{"name": "v", "field": "k"}]}, InvalidName), ({"indices": [{"name": "i", "field": "t"}]}, EngineError), ({"indices": [{"name": "i", "field": "k", "model": "?"}]}, EngineError),
    ({"indices": [{"name": "i", "field": "k", "model": "hashing/64", "dimensions": 8}]}, EngineError),
])
def test_schema_rules(engine, change, why):
    with pytest.raises(why):
        engine.create_table("db", FULL | change)
    engine.create_table("db", FULL)
    with pytest.raises(TableExists):
        engine.create_table("db", FULL)


def test_text_index(engine):
    calls = []

    def flaky(texts, headers):
        calls.append(len(texts))
        if len(calls) == 1:
            raise OSError("try again")
        return embed.hashed(64)(texts, headers)

    engine.registry.register(embed.Model("keyed/64", 64, embed.hashed(64), reducible=True, key_header="X-Key"))
    engine.create_table("db", payload("d", id="INT key", doc="STRING") | {"indices": [{"name": "i", "field": "doc", "model": "hashing/256"}]})
    engine.insert("db", "d", [{"id": 1, "doc": "the quick brown fox"}, {"id": 2, "doc": "lazy dogs sleep"}, {"id": 3, "doc": ""}])
    found = engine.query_text("db", "d", "quick brown foxes", limit=2, with_distance=True).collect()
    assert found[0].id == 1 and set(found[0].asDict()) == {"id", "doc", "@distance"}  # index fields aren't put out
    assert embed.embed_query(embed.Model("flaky", 64, flaky), "x", 64, wait=0.0) and calls == [1, 1]
    with pytest.raises(InvalidPayload):
        engine.registry.get("keyed/64")
    assert engine.registry.get("keyed/64", {"X-Key": "k"}).reducible and {m["model"] for m in engine.registry.list()} >= {"hashing/64", "keyed/64"}


def test_facets(spark):
    rows = spark.createDataFrame([(1, 2.5, "a", True), (2, 3.5, "b", False), (3, -1.0, "a", True), (4, 0.0, "a", False)], "id int, g double, s string, flag boolean")
    kinds = {"id": "INT", "g": "DOUBLE", "s": "STRING", "flag": "BOOL"}

    def run(group, *calls, df=rows, **more):
        return sorted(tuple(r) for r in facet(df, {"group": group, "aggregate": list(calls)}, kinds, **more).collect())

    assert run(["s"], "SUM(g)", "count(x y z)", "MIN(id)", "max(id + 1)") == [("a", 1.5, 3, 1, 5), ("b", 3.5, 1, 2, 3)]
    assert run(["id / 2"], "COUNT(1)") == [(0, 1), (1, 2), (2, 1)]
    assert run(["flag"], "SUM(id / 2)") == [(False, 3), (True, 2)]
    assert run([], "SUM(id)") == [(10,)] and run([], "SUM(id)", df=rows.where("id > 9")) == []
    assert run(["flag", "s"], "AVG(g)", extensions=True) == [(False, "a", 0.0), (False, "b", 3.5), (True, "a", 0.75)]
    assert run(["s"], "SUM(@distance)") == [("a", 0.0), ("b", 0.0)]
    for group, calls, why in ((["s"], [], InvalidPayload), (["s", "id"], ["COUNT(1)"], InvalidPayload), (["s"], ["AVG(g)"], InvalidExpr), (["s"], ["SUM(s)"], InvalidExpr), (["s"], ["MIN(flag)"], InvalidExpr), (["s"], ["SUM g"], InvalidExpr)):
        with pytest.raises(why):
            run(group, *calls)


def test_json_interface(spark, tmp_path):
    api = Api(Engine(spark))

    def call(method, path, payload=None, status=200):
        got, body = api.call(method, path, payload)
        assert got == status == body["statusCode"], body
        return body.get("result")

    call("GET", "/"), call("GET", "/state"), call("GET", "/nowhere", status=404), call("POST", "/api/load", "{", 400), call("POST", "/api/load", {}, 400)
    call("POST", "/api/load", {"name": "x", "path": str(tmp_path / "x")})
    call("POST", "/api/load", {"name": "x", "path": str(tmp_path / "x")}, 409)
    assert call("POST", "/api/x/schema/tables", FULL | {"returnTableId": True}) == {"tableId": 0}
    call("POST", "/api/x/schema/tables", FULL, 409), call("POST", "/api/x/schema/tables", {"name": "q"}, 400)
    assert call("GET", "/api/x/schema/tables/show") == ["m"] and call("GET", "/api/x/schema/tables/m/describe")["name"] == "m"
    assert call("POST", "/api/x/data/insert", {"table": "m", "data": [record("a", j={"p": 1}), record("b", t=2), record("a")]}) == {"inserted": 2, "skipped": 1}
    call("POST", "/api/x/data/insert", {"table": "m", "data": [{}]}, 500), call("POST", "/api/x/data/insert", {"table": "m"}, 400)
    assert call("POST", "/api/x/data/insertprepare", {"table": "m", "primaryKeys": ["a", "z"]})["masks"] == [0xFFFFFFFE]
    search = {"table": "m", "queryVector": [3, 4], "limit": 5, "withDistance": True, "response": ["k", "j"]}
    rows = call("POST", "/api/x/data/query", search)
    assert [r["k"] for r in rows] == ["a", "b"] and rows[0]["j"] == {"p": 1} and rows[0]["@distance"] == pytest.approx(0, abs=1e-6)
    groups = [{"group": ["b"], "aggregate": ["COUNT(1)"]}]
    both = call("POST", "/api/x/data/query", search | {"facets": groups})
    assert both["facets"] == [[{"b": True, "COUNT(1)": 2}]] and len(both["records"]) == 2
    assert call("POST", "/api/x/data/get", {"table": "m", "facets": groups}) == [[{"b": True, "COUNT(1)": 2}]]
    assert [r["k"] for r in call("POST", "/api/x/data/get", {"table": "m", "filter": "t > 1"})] == ["b"]
    for more, status in (({"filter": "t >"}, 400), ({"filter": "t & 1 = 1"}, 501), ({"queryVector": [1]}, 500), ({"queryField": "v", "queryIndex": "v"}, 400), ({"queryVector": {"indices": [1], "values": []}}, 400)):
        call("POST", "/api/x/data/query", search | more, status)
    call("POST", "/api/x/data/query", {"table": "m", "queryVector": [3, 4]}, 400), call("POST", "/api/x/data/query", {"table": "m", "limit": 1}, 400)
    call("POST", "/api/x/data/get", {"table": "m", "filter": "t >"}, 500), call("POST", "/api/x/data/get", {"table": "m", "primaryKeys": []}, 400)
    call("POST", "/api/x/data/delete", {"table": "m"}, 400), call("POST", "/api/x/data/delete", {"table": "m", "primaryKeys": []}, 400), call("POST", "/api/x/data/delete", {"table": "m", "filter": "q = 1"}, 400)
    assert call("POST", "/api/x/data/delete", {"table": "m", "primaryKeys": ["a"]}) == {"deleted": 1}
    (tmp_path / "rows.csv").write_text('k,t,f,b,j,at,v\nc,3,0.5,true,{},"{""latitude"":1,""longitude"":2}","[1.0, 0.0]"\n')
    assert call("POST", "/api/x/data/load", {"table": "m", "path": str(tmp_path / "rows.csv")}) == {"inserted": 1}
    assert call("GET", "/api/x/statistics") == [{"tableName": "m", "totalRecords": 2}]
    call("POST", "/api/config", {"SearchQueueSize": 600}), call("POST", "/api/config", {"SearchQueueSize": 6}, 400), call("POST", "/api/config", {"what": 6}, 400)
    call("POST", "/api/rebuild"), call("POST", "/api/setleader", {"leader": False}), call("POST", "/api/dump", {"name": "x", "path": str(tmp_path / "z")})
    call("POST", "/api/x/release"), call("DELETE", "/api/x/schema/tables/m"), call("POST", "/api/x/unload"), call("DELETE", "/api/x/drop", status=500)


def test_stream_is_taken_once(engine, spark, tmp_path):
    engine.create_table("db", payload("s", id="BIGINT", v="VECTOR_FLOAT 2"))
    df = spark.range(50).select("id", F.array(F.lit(1.0), F.lit(2.0)).cast("array<float>").alias("v"))
    df.write.parquet(str(tmp_path / "in"))

    def run():
        stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
        ingest(engine, "db", "s", stream, str(tmp_path / "checkpoint"), rebuild_every=1).awaitTermination()
        return engine.table("db", "s").count()

    assert run() == 50 and run() == 50
    df.write.mode("append").parquet(str(tmp_path / "in"))
    assert run() == 100
    assert engine.batch_done("db", "s", str(tmp_path / "checkpoint"), 1)


def test_two_engines_on_a_folder(spark, tmp_path):
    """A follower sees what the leader commits and doesn't write; of two writers none loses rows; readers outlive a rebuild."""
    path = f"{tmp_path}/two"
    lead, follow = Engine(spark), Engine(spark)
    lead.load_db("db", path)
    lead.create_table("db", payload("t", id="INT key", v="VECTOR_FLOAT 2"))
    follow.set_leader(False)
    follow.load_db("db", path)
    row = lambda i: {"id": i, "v": [float(i), 1.0]}
    lead.insert("db", "t", [row(1)])
    assert [r.id for r in follow.get("db", "t").collect()] == [1]
    for write in (lambda: follow.insert("db", "t", [row(2)]), lambda: follow.delete("db", "t", [1]), lambda: follow.rebuild("db")):
        with pytest.raises(NotLeader):
            write()
    other = Engine(spark)
    other.load_db("db", path)
    other.insert("db", "t", [row(3)])
    lead.insert("db", "t", [row(4)])  # takes up what the other has committed first
    assert sorted(r.id for r in follow.get("db", "t").collect()) == [1, 3, 4]
    stale = other.databases["db"]
    with pytest.raises(Conflict):
        stale.commit()
    before = lead.get("db", "t")
    lead.rebuild("db", "t")
    assert sorted(r.id for r in before.collect()) == [1, 3, 4]
    fresh = Engine(spark)
    fresh.load_db("again", path)
    assert sorted(r.id for r in fresh.get("again", "t").collect()) == [1, 3, 4]
