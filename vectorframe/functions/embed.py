"""Text embeddings by providers that can be plugged in.

A provider lists its models and embeds batches of texts. The one that is built in hashes
character trigrams into a unit vector: deterministic, and in need of no network.
"""

from __future__ import annotations

import time
import zlib
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vectorframe.errors import EngineError, InvalidPayload


@dataclass(frozen=True)
class Model:
    name: str
    dimensions: int
    embed: Callable[[list[str], dict], list[list[float]]]
    dense: bool = True
    reducible: bool = False
    #: Request header that must hold the provider's key; none for local models.
    key_header: str | None = None


def hashed(dimensions: int) -> Callable[[list[str], dict], list[list[float]]]:
    def embed(texts: list[str], headers: dict) -> list[list[float]]:
        out = np.zeros((len(texts), dimensions), dtype=np.float32)
        for row, text in zip(out, texts):
            s = f" {text.lower()} "
            for i in range(len(s) - 2):
                h = zlib.crc32(s[i : i + 3].encode())
                row[h % dimensions] += 1.0 if h >> 31 else -1.0
            n = np.linalg.norm(row)
            if n:
                row /= n
        return out.tolist()

    return embed


class Registry:
    """Models by name, with retries."""

    def __init__(self):
        self.models: dict[str, Model] = {}
        for n in (64, 256):
            self.register(Model(f"hashing/{n}", n, hashed(n)))

    def register(self, model: Model) -> None:
        self.models[model.name] = model

    def list(self) -> list[dict]:
        return [{"model": m.name, "dim": m.dimensions, "dense": m.dense, "dimensionReduction": m.reducible} for m in self.models.values()]

    def get(self, name: str, headers: dict | None = None) -> Model:
        if name not in self.models:
            raise EngineError(f"unknown embedding model: {name}")
        model = self.models[name]
        if model.key_header and not (headers or {}).get(model.key_header):
            raise InvalidPayload(f"header {model.key_header} is missing")
        return model


def _attempts(model: Model, texts: list[str], headers: dict, dimensions: int, attempts: int, wait: float) -> list[list[float]]:
    for i in range(attempts):
        try:
            return [v[:dimensions] for v in model.embed(texts, headers)]
        except Exception as why:
            if i == attempts - 1:
                raise EngineError(f"embedding failed: {why}") from why
            time.sleep(wait * 2**i)
    return []


def embed_query(model: Model, text: str, dimensions: int, headers: dict | None = None, wait: float = 1.0) -> list[float]:
    """A query's vector, on the driver, in two attempts at most."""
    return _attempts(model, [text], headers or {}, dimensions, 2, wait)[0]


def embed_column(model: Model, text: Column, dimensions: int, headers: dict | None = None, batch: int = 64, wait: float = 1.0) -> Column:
    """Unit vectors of a column, in Arrow batches on the executors, three attempts for each."""
    headers = headers or {}

    @F.arrow_udf(T.ArrayType(T.FloatType(), False))
    def embed(column: pa.Array) -> pa.Array:
        texts = [t or "" for t in column.to_pylist()]
        out = [v for i in range(0, len(texts), batch) for v in _attempts(model, texts[i : i + batch], headers, dimensions, 3, wait)]
        units = []
        for v in out:
            n = float(np.square(np.asarray(v, dtype=np.float64)).sum())
            units.append((np.asarray(v, dtype=np.float64) / np.sqrt(n)).astype(np.float32) if n > 1e-10 else np.asarray(v, dtype=np.float32))
        return pa.array(units, pa.list_(pa.float32()))

    return embed(text)
