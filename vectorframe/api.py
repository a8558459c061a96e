"""The JSON interface as plain calls: a method, a path and a payload give a status and a body.

No server is part of this; any that hands requests on can be put in front.
"""

from __future__ import annotations

import json
import math
import re

from pyspark.sql import DataFrame, Row

from vectorframe.engine import Engine
from vectorframe.errors import DatabaseExists, EngineError, InvalidExpr, InvalidPayload, NotImplementedExpr, TableExists
from vectorframe.schema import Table

Response = tuple[int, dict]


def _plain(value: object, kind: str | None = None) -> object:
    if isinstance(value, Row):
        return {k: _plain(v) for k, v in value.asDict().items()}
    if isinstance(value, list):
        return [_plain(v) for v in value]
    if kind == "JSON" and value is not None:
        return json.loads(value)
    return None if isinstance(value, float) and not math.isfinite(value) else value


def rows_of(df: DataFrame, table: Table | None = None) -> list[dict]:
    """Rows of a result (limited by the request) as JSON objects; JSON fields are parsed."""
    kinds = {f.name: f.type for f in table.fields} if table else {}
    return [{k: _plain(v, kinds.get(k)) for k, v in r.asDict().items()} for r in df.collect()]


class Api:
    def __init__(self, engine: Engine):
        self.engine = engine
        self.routes = [(m, re.compile(p), h) for m, p, h in (
            ("GET", r"/", self.root), ("GET", r"/state", self.state), ("POST", r"/api/load", self.load),
            ("POST", r"/api/(\w+)/unload", self.unload), ("POST", r"/api/(\w+)/release", self.release), ("DELETE", r"/api/(\w+)/drop", self.drop_db),
            ("POST", r"/api/dump", self.dump), ("POST", r"/api/(\w+)/schema/tables", self.create), ("DELETE", r"/api/(\w+)/schema/tables/(\w+)", self.drop),
            ("GET", r"/api/(\w+)/schema/tables/(\w+)/describe", self.describe), ("GET", r"/api/(\w+)/schema/tables/show", self.tables),
            ("POST", r"/api/(\w+)/data/insert", self.insert), ("POST", r"/api/(\w+)/data/insertprepare", self.prepare), ("POST", r"/api/(\w+)/data/delete", self.delete),
            ("POST", r"/api/(\w+)/data/load", self.load_csv), ("GET", r"/api/(\w+)/statistics", self.statistics), ("POST", r"/api/(\w+)/data/query", self.query),
            ("POST", r"/api/(\w+)/data/get", self.get), ("POST", r"/api/rebuild", self.rebuild), ("POST", r"/api/setleader", self.set_leader), ("POST", r"/api/config", self.configure),
        )]

    def call(self, method: str, path: str, payload: dict | str | None = None, headers: dict | None = None) -> Response:
        if isinstance(payload, str):
            try:
                payload = json.loads(payload)
            except ValueError:
                return self._said(400, "the payload isn't JSON")
        for m, pattern, handler in self.routes:
            if m == method and (found := pattern.fullmatch(path)):
                try:
                    return handler(*found.groups(), payload=payload or {}, headers=headers or {})
                except EngineError as why:
                    return self._said(getattr(handler, "failure", 500), why.message)
        return self._said(404, f"no such endpoint: {method} {path}")

    @staticmethod
    def _said(status: int, message: str, **more) -> Response:
        return status, {"statusCode": status, "message": message, **more}

    @staticmethod
    def _needs(payload: dict, *names: str) -> Response | None:
        missing = [n for n in names if n not in payload]
        return Api._said(400, f"the payload lacks {missing[0]}") if missing else None

    def root(self, payload, headers) -> Response:
        return self._said(200, "ready")

    def state(self, payload, headers) -> Response:
        return self._said(200, "the server is online")

    def load(self, payload, headers) -> Response:
        if bad := self._needs(payload, "name", "path"):
            return bad
        try:
            self.engine.load_db(payload["name"], payload["path"], payload.get("walEnabled", True), headers)
        except DatabaseExists as why:
            return self._said(409, why.message)
        return self._said(200, f"{payload['name']} is loaded")

    def unload(self, db, payload, headers) -> Response:
        self.engine.unload_db(db)
        return self._said(200, f"{db} is unloaded")

    def release(self, db, payload, headers) -> Response:
        self.engine.release_db(db)
        return self._said(200, f"{db} is released")

    def drop_db(self, db, payload, headers) -> Response:
        self.engine.drop_db(db)
        return self._said(200, f"{db} is dropped")

    def dump(self, payload, headers) -> Response:
        if bad := self._needs(payload, "name", "path"):
            return bad
        self.engine.dump_db(payload["name"], payload["path"])
        return self._said(200, f"{payload['name']} is dumped")

    def create(self, db, payload, headers) -> Response:
        try:
            number = self.engine.create_table(db, payload)
        except TableExists as why:
            return self._said(409, why.message)
        except InvalidPayload as why:
            return self._said(400, why.message)
        return self._said(200, f"{payload['name']} is created", **({"result": {"tableId": number}} if payload.get("returnTableId") else {}))

    def drop(self, db, table, payload, headers) -> Response:
        self.engine.drop_table(db, table)
        return self._said(200, f"{table} is dropped")

    def describe(self, db, table, payload, headers) -> Response:
        return self._said(200, table, result=self.engine.describe_table(db, table))

    def tables(self, db, payload, headers) -> Response:
        return self._said(200, db, result=self.engine.list_tables(db))

    def insert(self, db, payload, headers) -> Response:
        if bad := self._needs(payload, "table", "data"):
            return bad
        done = self.engine.insert(db, payload["table"], payload["data"], bool(payload.get("upsert", False)), headers)
        return self._said(200, f"rows went to {payload['table']}", result=done)

    def prepare(self, db, payload, headers) -> Response:
        if bad := self._needs(payload, "table", "primaryKeys"):
            return bad
        return self._said(200, payload["table"], result=self.engine.insert_prepare(db, payload["table"], payload["primaryKeys"]))

    def delete(self, db, payload, headers) -> Response:
        if bad := self._needs(payload, "table"):
            return bad
        keys, text = payload.get("primaryKeys"), payload.get("filter", "")
        if keys is not None and not keys or not keys and not text:
            return self._said(400, "a deletion needs keys or a filter")
        try:
            return self._said(200, payload["table"], result=self.engine.delete(db, payload["table"], keys, text))
        except EngineError as why:
            return self._said(400, why.message)

    def load_csv(self, db, payload, headers) -> Response:
        if bad := self._needs(payload, "table", "path"):
            return bad
        from vectorframe.sources.files import read_csv

        _, s = self.engine._open(db, payload["table"])
        rows = read_csv(self.engine.spark, payload["path"], s.table, bool(payload.get("header", True)))
        return self._said(200, payload["table"], result=self.engine.insert_frame(db, payload["table"], rows, bool(payload.get("upsert", False)), headers))

    def statistics(self, db, payload, headers) -> Response:
        return self._said(200, db, result=self.engine.statistics(db))

    def _envelope(self, db: str, payload: dict, answer) -> Response:
        table = self.engine._open(db, payload["table"])[1].table
        if isinstance(answer, DataFrame):
            return self._said(200, payload["table"], result=rows_of(answer, table))
        rows, facets = answer
        groups = [rows_of(f) for f in facets]
        return self._said(200, payload["table"], result=groups if rows is None else {"records": rows_of(rows, table), "facets": groups})

    def query(self, db, payload, headers) -> Response:
        if bad := self._needs(payload, "table", "limit"):
            return bad
        if "queryField" in payload and "queryIndex" in payload:
            return self._said(400, "name a field or an index, not both")
        field = payload.get("queryField") or payload.get("queryIndex")
        more = {"limit": payload["limit"], "filter": payload.get("filter", ""), "response": payload.get("response"), "with_distance": bool(payload.get("withDistance", False)), "facets": payload.get("facets")}
        try:
            if "queryVector" in payload:
                answer = self.engine.query(db, payload["table"], payload["queryVector"], field, **more)
            elif "query" in payload:
                answer = self.engine.query_text(db, payload["table"], payload["query"], field, headers=headers, **more)
            else:
                return self._said(400, "the payload lacks query or queryVector")
            return self._envelope(db, payload, answer)
        except (InvalidExpr, InvalidPayload) as why:
            return self._said(400, why.message)
        except NotImplementedExpr as why:
            return self._said(501, why.message)

    def get(self, db, payload, headers) -> Response:
        if bad := self._needs(payload, "table"):
            return bad
        keys = payload.get("primaryKeys")
        if keys is not None and not keys:
            return self._said(400, "the list of keys is empty")
        answer = self.engine.get(db, payload["table"], keys, payload.get("filter", ""), payload.get("skip", 0), payload.get("limit"), payload.get("response"), payload.get("facets"))
        return self._envelope(db, payload, answer)

    def rebuild(self, payload, headers) -> Response:
        for db in self.engine.databases:
            self.engine.rebuild(db)
        return self._said(200, "rebuilt")

    def set_leader(self, payload, headers) -> Response:
        self.engine.set_leader(bool(payload.get("leader", True)))
        return self._said(200, "leader" if self.engine.leader else "follower")

    def configure(self, payload, headers) -> Response:
        try:
            self.engine.config.update(payload)
        except InvalidPayload as why:
            return self._said(400, why.message)
        return self._said(200, "configured")
