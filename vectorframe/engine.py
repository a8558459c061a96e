"""The engine: databases, mutations and reads over a Spark session."""

from __future__ import annotations

from dataclasses import dataclass, fields

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vectorframe import schema
from vectorframe.errors import Conflict, DatabaseExists, EngineError, InvalidName, InvalidPayload, NotLeader
from vectorframe.functions import embed, metrics
from vectorframe.operators import ann, mutate, search
from vectorframe.operators.facets import facet
from vectorframe.plans.parser import parse
from vectorframe.schema import RID
from vectorframe.sources.catalog import Database, Stored, require


@dataclass
class Config:
    """Settings with the ranges they are checked against. Those that steer threads of a
    single process are kept for callers, Spark's scheduler takes their place."""

    intra_query_threads: int = 4
    search_queue_size: int = 500
    num_executor_per_field: int = 16
    rebuild_threads: int = 1
    min_graph_size: int = 100
    pre_filter: bool = True
    ann_probes: int = 0  # cells read by an approximate search; 0 for a share that keeps recall

    _ranges = {"intra_query_threads": (1, 128), "search_queue_size": (500, 10_000_000), "num_executor_per_field": (1, 128), "rebuild_threads": (1, 128), "min_graph_size": (1, 1 << 40), "ann_probes": (0, 4096)}
    _names = {"IntraQueryThreads": "intra_query_threads", "SearchQueueSize": "search_queue_size", "NumExecutorPerField": "num_executor_per_field", "RebuildThreads": "rebuild_threads", "MinimalGraphSize": "min_graph_size", "PreFilter": "pre_filter", "AnnProbes": "ann_probes"}

    def update(self, settings: dict) -> None:
        for name, value in settings.items():
            key = self._names.get(name, name)
            if key not in {f.name for f in fields(self)}:
                raise InvalidPayload(f"unknown setting: {name}")
            low, high = self._ranges.get(key, (False, True))
            if not low <= value <= high:
                raise InvalidPayload(f"{name} must be from {low} to {high}")
            setattr(self, key, type(getattr(self, key))(value))


class Engine:
    def __init__(self, spark: SparkSession, registry: embed.Registry | None = None):
        self.spark, self.registry, self.config = spark, registry or embed.Registry(), Config()
        self.databases: dict[str, Database] = {}
        self.leader = True

    # ------------------------------------------------------------ databases

    def load_db(self, name: str, path: str, wal_enabled: bool = True, headers: dict | None = None) -> None:
        """Open the database at ``path``, or create it; entries of its logs that no snapshot has are applied."""
        if not schema.valid_name(name):
            raise InvalidName(f"invalid database name: {name}")
        if name in self.databases or path.rstrip("/") in {d.path for d in self.databases.values()}:
            raise DatabaseExists(f"database exists already: {name}")
        db = self.databases[name] = Database(self.spark, name, path, wal_enabled)
        for s in db.tables.values() if self.leader else ():
            for number, kind, payload in list(db.log(s).after(s.wal_id)):
                try:
                    if kind == "DELETE":
                        self._delete(db, s, payload.get("primaryKeys"), payload.get("filter", ""), number)
                    else:
                        self._insert(db, s, payload, kind == "UPSERT", headers or {}, number)
                except Conflict:
                    raise
                except EngineError:  # it failed when it was logged, too
                    s.wal_id = number
                    db.commit()

    def unload_db(self, name: str) -> None:
        require(self.databases, name)
        del self.databases[name]

    def release_db(self, name: str) -> None:
        require(self.databases, name)
        self.spark.catalog.clearCache()

    drop_db = unload_db

    def dump_db(self, name: str, path: str) -> None:
        require(self.databases, name).dump(path)

    # ------------------------------------------------------------ tables

    def create_table(self, database: str, payload: dict) -> int:
        self._may_write()
        table = schema.parse_table(payload, self.registry.models)
        return require(self.databases, database).create(table).table.id

    def drop_table(self, database: str, name: str) -> None:
        require(self.databases, database).drop(name)

    def list_tables(self, database: str) -> list[str]:
        return sorted(require(self.databases, database).tables)

    def describe_table(self, database: str, name: str) -> dict:
        return schema.to_json(require(self.databases, database).get(name).table)

    def statistics(self, database: str) -> list[dict]:
        """Live rows of each table, kept by the catalog."""
        db = require(self.databases, database)
        return [{"tableName": n, "totalRecords": db.tables[n].rows} for n in sorted(db.tables)]

    def _open(self, database: str, table: str, write: bool = False) -> tuple[Database, Stored]:
        """A table; a follower sees what the leader has committed, and can't write."""
        db = require(self.databases, database)
        if write:
            self._may_write()
        elif not self.leader:
            db.refresh()
        return db, db.get(table)

    def _may_write(self) -> None:
        if not self.leader:
            raise NotLeader("a follower doesn't write; ask the leader")

    def table(self, database: str, table: str) -> DataFrame:
        """Live rows as a DataFrame, with their ids."""
        db, s = self._open(database, table)
        return db.read(s)

    # ------------------------------------------------------------ mutations

    def insert(self, database: str, table: str, records: list[dict], upsert: bool = False, headers: dict | None = None) -> dict:
        db, s = self._open(database, table, True)
        db.refresh()
        s = db.get(table)
        number = s.wal_id + 1
        db.log(s).append(number, "UPSERT" if upsert else "INSERT", records)
        return self._insert(db, s, records, upsert, headers or {}, number)

    def _insert(self, db: Database, s: Stored, records: list[dict], upsert: bool, headers: dict, number: int) -> dict:
        rows, skipped = mutate.rows_of(records, s.table)
        done = self._add(db, s, mutate.frame_of(self.spark, rows, s.table), upsert, headers, number)
        return {"inserted": done, "skipped": skipped + len(rows) - done}

    def insert_frame(self, database: str, table: str, rows: DataFrame, upsert: bool = False, headers: dict | None = None, batch: tuple[str, int] | None = None) -> dict:
        """Bulk form: rows with the table's columns, checked and added in the JVM; no log entry."""
        db, s = self._open(database, table, True)
        return {"inserted": self._add(db, s, mutate.checked(rows, s.table), upsert, headers or {}, s.wal_id, batch)}

    def batch_done(self, database: str, table: str, stream: str, number: int) -> bool:
        return self._open(database, table)[1].batches.get(stream, -1) >= number

    def _add(self, db: Database, s: Stored, rows: DataFrame, upsert: bool, headers: dict, number: int, batch: tuple[str, int] | None = None) -> int:
        base, key = db.read(s), s.table.key
        if key is not None:
            rows = mutate.first_of_batch(rows, key.name, last=True) if upsert else mutate.new_rows(base, rows, key.name)
        for i in s.table.indices:
            model = self.registry.get(i.model, headers)
            rows = rows.withColumn(i.name, embed.embed_column(model, F.col(i.field), i.dimensions, headers))
        # all is written before anything is seen: one commit makes the batch visible
        path, n, next_rid = db.append(s, rows.select(s.table.spark().names))
        gone = 0
        if upsert and key is not None and s.segments:
            fresh = self.spark.read.schema(s.table.spark()).parquet(f"{db.path}/{path}")
            dead = db.write(s, mutate.replaced(base, fresh, key.name), "gone")
            gone = self.spark.read.schema(f"{RID} long").parquet(f"{db.path}/{dead}").count()
            if gone:
                s.tombstones.append(dead)
        s.segments.append(path)
        s.next_rid, s.rows, s.wal_id, s.version = next_rid, s.rows + n - gone, number, s.version + 1
        if batch:
            s.batches[batch[0]] = batch[1]
        db.commit()
        return n

    def insert_prepare(self, database: str, table: str, keys: list) -> dict:
        db, s = self._open(database, table)
        return mutate.prepare(db.read(s), s.table, keys)

    def delete(self, database: str, table: str, keys: list | None = None, filter: str = "") -> dict:
        db, s = self._open(database, table, True)
        db.refresh()
        s = db.get(table)
        mutate.deleted(db.read(s), s.table, keys, filter)  # fails before it is logged
        number = s.wal_id + 1
        db.log(s).append(number, "DELETE", {"primaryKeys": keys, "filter": filter})
        return self._delete(db, s, keys, filter, number)

    def _delete(self, db: Database, s: Stored, keys: list | None, filter: str, number: int) -> dict:
        dead = db.write(s, mutate.deleted(db.read(s), s.table, keys, filter), "gone")
        n = self.spark.read.schema(f"{RID} long").parquet(f"{db.path}/{dead}").count()
        if n:
            s.tombstones.append(dead)
        s.rows, s.wal_id, s.version = s.rows - n, number, s.version + 1
        db.commit()
        return {"deleted": n}

    # ------------------------------------------------------------ reads

    def query(self, database: str, table: str, vector: object, field: str | None = None, limit: int = 10, filter: str = "", response: list[str] | None = None, with_distance: bool = False, facets: list[dict] | None = None, approximate: bool = False, compat_distance_scope: bool = False):
        """Nearest rows, exact and uncapped; with ``approximate``, from the nearest cells of the
        last rebuild and all rows written since. Facets cover the rows returned."""
        db, s = self._open(database, table)
        f = search.resolve(s.table, field)
        rows = self._candidates(db, s, f, vector) if approximate else db.read(s)
        found = search.nearest(rows, s.table, f, vector, limit, filter, compat_distance_scope)
        return self._answer(found, s, response, with_distance, facets, True)

    def query_text(self, database: str, table: str, text: str, index: str | None = None, limit: int = 10, headers: dict | None = None, **more):
        _, s = self._open(database, table)
        f = search.resolve(s.table, index, index=True)
        of = next((i for i in s.table.indices if i.name == f.name), None)
        if of is None:
            raise InvalidPayload(f"{f.name} isn't an index")
        vector = embed.embed_query(self.registry.get(of.model, headers), text, of.dimensions, headers)
        return self.query(database, table, vector, f.name, limit, **more)

    def get(self, database: str, table: str, keys: list | None = None, filter: str = "", skip: int = 0, limit: int | None = None, response: list[str] | None = None, facets: list[dict] | None = None, ordered: bool = True):
        """Rows by key or filter, in order of their ids; with ``ordered=False`` a result without
        skip and limit isn't sorted, which spares a shuffle."""
        db, s = self._open(database, table)
        found = search.lookup(db.read(s), s.table, keys, filter, skip, limit, ordered and not facets)
        return self._answer(found, s, response, False, facets, False)

    def _answer(self, found: DataFrame, s: Stored, response, with_distance: bool, facets, measured: bool):
        rows = search.project(found, s.table, response, with_distance)
        if not facets:
            return rows
        kinds = search.types_of(s.table)
        made = [facet(found, spec, kinds, search.distance_column(measured)) for spec in facets]
        return (rows if response else None), made

    # ------------------------------------------------------------ approximate search

    def _candidates(self, db: Database, s: Stored, f: schema.Field, vector: object) -> DataFrame:
        known = s.ann.get(f.name)
        if not known or f.type not in schema.DENSE:
            return db.read(s)
        query = metrics.check_query(f, vector)
        near = ann.probe(self.spark, f"{db.path}/{known['uri']}", s.table.spark(), query, np.asarray(known["centres"]), self.config.ann_probes)
        live = db.read(s).where(F.col(RID) >= known["next_rid"])  # rows since
        if s.tombstones:
            gone = self.spark.read.schema(f"{RID} long").parquet(*[f"{db.path}/{p}" for p in s.tombstones])
            near = near.join(gone, RID, "left_anti").select(live.columns)
        return near.unionByName(live)

    def rebuild(self, database: str, table: str | None = None) -> None:
        """Fold each table into one segment and file its dense vectors by cells, where rows changed."""
        self._may_write()
        db = require(self.databases, database)
        db.refresh()
        for s in [db.get(table)] if table else list(db.tables.values()):
            changed = db.rebuild(s)
            for f in s.table.vectors():
                if f.type in schema.DENSE and s.rows >= self.config.min_graph_size and (changed or f.name not in s.ann):
                    uri = f"{s.table.id}/cells-{f.name}-{s.version}"
                    centres = ann.build(db.read(s), f, f"{db.path}/{uri}")
                    s.ann[f.name] = {"uri": uri, "centres": centres.tolist(), "next_rid": s.next_rid}
            db.commit()

    def set_leader(self, leader: bool) -> None:
        self.leader = leader

    def parse_filter(self, database: str, table: str, text: str):
        """The typed tree of a filter, for looking at it."""
        return parse(text, search.types_of(self._open(database, table)[1].table))
