"""Table schemas: declared types, metrics, validation, and their Spark form."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import types as T

from vectorframe.errors import EngineError, InvalidName, InvalidPayload

DENSE, SPARSE = {"VECTOR_FLOAT", "VECTOR_DOUBLE"}, {"SPARSE_VECTOR_FLOAT", "SPARSE_VECTOR_DOUBLE"}
METRICS = ("EUCLIDEAN", "COSINE", "DOT_PRODUCT")
INTEGERS = {"TINYINT": 8, "SMALLINT": 16, "INT": 32, "BIGINT": 64}
FLOATS = {"FLOAT", "DOUBLE"}
KEYS = {*INTEGERS, "STRING"}
#: Position of a row in its table: ties and scans follow it.
RID = "_rid"

_SPARK = {
    "TINYINT": T.ByteType(), "SMALLINT": T.ShortType(), "INT": T.IntegerType(), "BIGINT": T.LongType(), "FLOAT": T.FloatType(), "DOUBLE": T.DoubleType(),
    "STRING": T.StringType(), "JSON": T.StringType(), "BOOL": T.BooleanType(),
    "GEO_POINT": T.StructType([T.StructField("latitude", T.DoubleType(), False), T.StructField("longitude", T.DoubleType(), False)]),
    **{d: T.ArrayType(T.FloatType(), False) for d in DENSE},
    **{s: T.StructType([T.StructField("indices", T.ArrayType(T.LongType(), False), False), T.StructField("values", T.ArrayType(T.FloatType(), False), False)]) for s in SPARSE},
}


@dataclass
class Field:
    name: str
    type: str = "INT"
    primary_key: bool = False
    dimensions: int = 0
    metric: str = "EUCLIDEAN"
    index: bool = False  # filled by an embedding of another field

    @property
    def vector(self) -> bool:
        return self.type in DENSE or self.type in SPARSE

    def spark(self) -> T.StructField:
        return T.StructField(self.name, _SPARK[self.type], False, {"type": self.type, "primaryKey": self.primary_key, "dimensions": self.dimensions, "metric": self.metric, "index": self.index})


@dataclass
class Index:
    name: str
    field: str
    model: str
    dimensions: int = 0


@dataclass
class Table:
    name: str
    fields: list[Field]
    indices: list[Index] = field(default_factory=list)
    auto_embeddings: list[dict] = field(default_factory=list)  # kept, without behaviour
    id: int = 0

    @property
    def key(self) -> Field | None:
        return next((f for f in self.fields if f.primary_key), None)

    def get(self, name: str) -> Field | None:
        return next((f for f in self.fields if f.name == name), None)

    def vectors(self, index: bool | None = None) -> list[Field]:
        return [f for f in self.fields if f.vector and (index is None or f.index == index)]

    def spark(self) -> T.StructType:
        return T.StructType([T.StructField(RID, T.LongType(), False), *(f.spark() for f in self.fields)])

    def default_response(self) -> list[str]:
        return [f.name for f in self.fields if not f.index]


_NAME = re.compile(r"[^\W\d]\w*", re.ASCII)


def valid_name(name: object) -> bool:
    return isinstance(name, str) and bool(_NAME.fullmatch(name))


def payload(table: str, /, **declared: str) -> dict:
    """Payload of a table from short declarations: a type, then ``key``, or a vector's dimensions and metric."""
    fields = []
    for name, text in declared.items():
        kind, *more = text.split()
        f = {"name": name, "dataType": kind}
        if more == ["key"]:
            f["primaryKey"] = True
        elif more:
            f |= dict(zip(("dimensions", "metricType"), (int(more[0]), *more[1:])))
        fields.append(f)
    return {"name": table, "fields": fields}


def parse_table(payload: dict, models: dict) -> Table:
    """Table of a JSON payload, checked by all rules of the catalog.

    ``models`` maps a model's name to an object with ``dimensions`` and ``reducible``.
    """
    if not isinstance(payload, dict) or "name" not in payload:
        raise InvalidPayload("the payload lacks a table name")
    if "fields" not in payload:
        raise InvalidPayload("the payload lacks fields")
    fields = []
    for f in payload["fields"]:
        kind = str(f.get("dataType", "INT")).upper()
        made = Field(f.get("name"), kind, bool(f.get("primaryKey", False)), int(f.get("dimensions", 0)), str(f.get("metricType", "EUCLIDEAN")).upper())
        if made.vector and "dimensions" not in f:
            raise InvalidPayload(f"vector field {made.name} lacks dimensions")
        fields.append(made)
    table = Table(payload["name"], fields, auto_embeddings=list(payload.get("autoEmbedding", [])))
    for i in payload.get("indices", []):
        table.indices.append(Index(i.get("name"), i.get("field"), i.get("model", "hashing/256"), int(i.get("dimensions", 0))))
    validate(table, models)
    return table


def validate(table: Table, models: dict) -> None:
    """Raise for a table that the catalog can't hold; add the vector fields of its indices."""
    if not valid_name(table.name):
        raise InvalidName(f"invalid table name: {table.name}")
    seen = set()
    for f in table.fields:
        if not valid_name(f.name):
            raise InvalidName(f"invalid field name: {f.name}")
        if f.name in seen:
            raise InvalidName(f"field name used twice: {f.name}")
        seen.add(f.name)
        if f.type not in _SPARK:
            raise EngineError(f"unknown type of field {f.name}: {f.type}")
        if f.vector and f.dimensions <= 0:
            raise EngineError(f"dimensions of {f.name} must be positive")
        if f.vector and f.metric not in METRICS:
            raise EngineError(f"unknown metric of {f.name}: {f.metric}")
        if f.primary_key and f.type not in KEYS:
            raise EngineError(f"a {f.type} field can't be the primary key")
    if sum(f.primary_key for f in table.fields) > 1:
        raise InvalidPayload("at most one field can be the primary key")
    for i in table.indices:
        if not valid_name(i.name) or i.name in seen:
            raise InvalidName(f"invalid or used index name: {i.name}")
        seen.add(i.name)
        source = table.get(i.field)
        if source is None or source.type != "STRING":
            raise EngineError(f"index {i.name} needs a STRING field")
        if i.model not in models:
            raise EngineError(f"unknown embedding model: {i.model}")
        model = models[i.model]
        size = model.dimensions
        if i.dimensions:
            if i.dimensions > size or (i.dimensions < size and not model.reducible):
                raise EngineError(f"model {i.model} can't give {i.dimensions} dimensions")
            size = i.dimensions
        i.dimensions = size
        if table.get(i.name) is None:
            table.fields.append(Field(i.name, "VECTOR_FLOAT", False, size, "COSINE", True))
    if not table.vectors():
        raise EngineError("a table needs a vector field or an index")


def to_json(table: Table) -> dict:
    return {"id": table.id, "name": table.name, "fields": [vars(f) for f in table.fields], "indices": [vars(i) for i in table.indices], "auto_embeddings": table.auto_embeddings}


def from_json(d: dict) -> Table:
    return Table(d["name"], [Field(**f) for f in d["fields"]], [Index(**i) for i in d["indices"]], d["auto_embeddings"], d["id"])
