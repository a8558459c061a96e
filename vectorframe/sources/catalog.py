"""Databases and tables on disk.

A database is a folder with one catalog file, replaced whole by every commit. A table is a
list of Parquet segments and a list of tombstone files (row ids), both only ever added to: a
mutation writes what it adds and never rewrites the table. ``rebuild`` folds them into one
segment. Readers resolve the catalog once and keep a consistent snapshot: what a rebuild replaces
is removed by the next one, not at once.

Catalogs are numbered. A commit creates the file of the next number and fails if it is there, so
of two writers one gets a ``Conflict`` and nothing that was committed is lost; ``refresh`` reads
the latest.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vectorframe.errors import Conflict, NotFound, TableExists, TableNotFound
from vectorframe.schema import RID, Table, from_json, to_json
from vectorframe.sources.storage import copy_tree, create_text, listed, read_text, remove_file, remove_tree
from vectorframe.sources.wal import Log


#: Catalogs that stay for readers which have just looked up the latest number.
KEPT_CATALOGS = 16


@dataclass
class Stored:
    table: Table
    segments: list[str] = field(default_factory=list)
    tombstones: list[str] = field(default_factory=list)
    next_rid: int = 0
    rows: int = 0
    wal_id: int = 0
    version: int = 0
    ann: dict = field(default_factory=dict)  # field name -> {uri, centres, next_rid}
    batches: dict = field(default_factory=dict)  # stream checkpoint -> last batch
    retired: list[str] = field(default_factory=list)  # replaced by the last rebuild


class Database:
    def __init__(self, spark: SparkSession, name: str, path: str, wal: bool = True):
        self.spark, self.name, self.path, self.wal = spark, name, path.rstrip("/"), wal
        self.number, self.tables = -1, {}
        self.refresh()
        if self.number < 0:
            self.commit()

    def _latest(self) -> int:
        """Number of the newest catalog; -1 where there is none."""
        return max((int(n[8:-5]) for n in listed(self.path) if n.startswith("catalog-") and n[8:-5].isdigit()), default=-1)

    def refresh(self) -> bool:
        """Take up what others have committed; whether there was anything."""
        number = self._latest()
        if number == self.number:
            return False
        text = read_text(f"{self.path}/catalog-{number:020d}.json")
        if text is None:  # replaced meanwhile
            return self.refresh()
        self.tables: dict[str, Stored] = {}
        for d in json.loads(text)["tables"]:
            self.tables[d["table"]["name"]] = Stored(**(d | {"table": from_json(d["table"])}))
        self.number = number
        return True

    def commit(self) -> None:
        """Make the tables as they are here the next catalog; ``Conflict`` if another writer was first."""
        tables = [vars(s) | {"table": to_json(s.table)} for s in self.tables.values()]
        number = self.number + 1
        if self._latest() >= number or not create_text(f"{self.path}/catalog-{number:020d}.json", json.dumps({"name": self.name, "tables": tables})):
            self.refresh()
            raise Conflict("another writer has committed since; nothing was changed")
        self.number = number
        if number >= KEPT_CATALOGS:
            remove_file(f"{self.path}/catalog-{number - KEPT_CATALOGS:020d}.json")

    def get(self, name: str) -> Stored:
        if name not in self.tables:
            raise TableNotFound(f"table not found: {name}")
        return self.tables[name]

    def log(self, s: Stored) -> Log:
        return Log(f"{self.path}/{s.table.id}/wal", self.wal)

    def create(self, table: Table) -> Stored:
        if table.name in self.tables:
            raise TableExists(f"table exists already: {table.name}")
        table.id = max((s.table.id for s in self.tables.values()), default=-1) + 1
        self.tables[table.name] = Stored(table)
        self.commit()
        return self.tables[table.name]

    def drop(self, name: str) -> None:
        s = self.get(name)
        del self.tables[name]
        self.commit()
        remove_tree(f"{self.path}/{s.table.id}")

    def read(self, s: Stored) -> DataFrame:
        """Live rows. Segments are one scan; tombstones are joined away by row id."""
        schema = s.table.spark()
        if not s.segments:
            return self.spark.createDataFrame([], schema)
        rows = self.spark.read.schema(schema).parquet(*[f"{self.path}/{p}" for p in s.segments])
        if s.tombstones:
            gone = self.spark.read.schema(f"{RID} long").parquet(*[f"{self.path}/{p}" for p in s.tombstones])
            rows = rows.join(gone, RID, "left_anti").select(schema.names)
        return rows

    def write(self, s: Stored, df: DataFrame, kind: str) -> str:
        """Write rows or row ids as a new folder; its path in the database."""
        path = f"{s.table.id}/{kind}-{uuid.uuid4().hex}"
        df.write.parquet(f"{self.path}/{path}")
        return path

    def append(self, s: Stored, rows: DataFrame) -> tuple[str, int, int]:
        """Write rows with ids above all others, in order of their _rid; (path, rows, next id).

        Nothing is committed: the caller sets the fields of ``s`` and commits once.
        """
        path = self.write(s, rows.withColumn(RID, F.col(RID) + F.lit(s.next_rid)), "rows")
        n, last = self.spark.read.schema(f"{RID} long").parquet(f"{self.path}/{path}").agg(F.count(F.lit(1)), F.max(RID)).first()
        return path, n, s.next_rid if last is None else last + 1

    def rebuild(self, s: Stored) -> bool:
        """Fold segments and tombstones into one segment; False if there was nothing to do."""
        if len(s.segments) <= 1 and not s.tombstones:
            return False
        rows = self.read(s)
        old = [*s.segments, *s.tombstones]
        gone, s.retired = s.retired, old
        s.segments, s.tombstones = [self.write(s, rows, "rows")], []
        s.version += 1
        self.commit()
        self.log(s).trim(s.wal_id)
        for p in gone:
            remove_tree(f"{self.path}/{p}")
        return True

    def dump(self, path: str) -> None:
        """Copy all live rows, indices and the catalog to another folder."""
        other = Database(self.spark, self.name, path, wal=False)
        for s in self.tables.values():
            made = Stored(s.table, next_rid=s.next_rid, rows=s.rows, wal_id=s.wal_id, version=s.version, batches=dict(s.batches))
            if s.segments:
                made.segments = [other.write(made, self.read(s), "rows")]
                for f, known in s.ann.items():  # rows that are gone stay in the cells: their ids go along
                    copy_tree(f"{self.path}/{known['uri']}", f"{other.path}/{known['uri']}")
                    made.ann[f] = dict(known)
                if s.ann and s.tombstones:
                    gone = self.spark.read.schema(f"{RID} long").parquet(*[f"{self.path}/{p}" for p in s.tombstones])
                    made.tombstones = [other.write(made, gone, "gone")]
            other.tables[s.table.name] = made
        other.commit()


def require(databases: dict[str, Database], name: str) -> Database:
    if name not in databases:
        raise NotFound(f"database not found: {name}")
    return databases[name]
