"""The nearest rows of many dense queries, exactly: blocks of queries against blocks of rows.

A matrix product gives all distances of a block but for rounding, whose size has a bound. Pairs
that could be among the nearest within that bound are measured again one value after the other in
double precision, as SQL and the higher-order functions do it, and only these distances are
compared. Products are of single precision, and of double where too many pairs lie within the bound.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq

from vectorframe.sources.storage import filesystem

#: Queries of a task, at most; values of rows read at once.
QUERIES, BLOCK_VALUES = 4096, 1 << 19
#: Queries and rows of a product, rows of the first one, and values of pairs measured at once.
PIECE, TILE, FIRST, PAIR_VALUES = 256, 2048, 512, 1 << 20
#: Twice the unit of rounding, what underflow may lose, and the squared length above which a vector isn't screened.
UNIT = {np.float32: 2.0**-23, np.float64: 2.0**-52}
TINY = {np.float32: 1e-37, np.float64: 1e-300}
LARGEST = {np.float32: 1e30, np.float64: 1e300}


def matrix(column: pa.Array, dimensions: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dimensions)


def read_blocks(files: list[str], dimensions: int) -> Iterator[tuple[pa.Array, np.ndarray]]:
    """Ids and vectors of Parquet files with these two columns, a bounded number of rows at a time."""
    for uri in files:
        fs, path = filesystem(uri)
        with fs.open_input_file(path) as source:
            for batch in pq.ParquetFile(source).iter_batches(batch_size=max(1, BLOCK_VALUES // dimensions)):
                yield batch.column(0), matrix(batch.column(1), dimensions)


def exact(q: np.ndarray, r: np.ndarray, metric: str) -> np.ndarray:
    """Distances of pairs, added up in the order of the dimensions."""
    total = np.cumsum((q - r) ** 2 if metric == "EUCLIDEAN" else q * r, axis=1)[:, -1]
    return total if metric == "EUCLIDEAN" else 1.0 - total if metric == "COSINE" else -total


class Tile:
    """Some rows, and their side of the product: the vector, and what its length adds to the distance.
    Rows that can't be screened have NaN there, which no limit rules out."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, metric: str):
        self.ids, self.vectors, self.euclidean = ids, vectors, metric == "EUCLIDEAN"
        self.squares = np.einsum("ij,ij->i", vectors, vectors)
        self.sides: dict[type, tuple[np.ndarray, float]] = {}

    def side(self, kind: type) -> tuple[np.ndarray, float]:
        """The matrix, transposed, and the largest length in it."""
        if kind not in self.sides:
            fit = self.squares < LARGEST[kind]
            added = np.where(fit, self.squares if self.euclidean else 0.0, np.nan)
            self.sides[kind] = np.column_stack([self.vectors, added]).astype(kind).T, float(np.sqrt(self.squares[fit].max(initial=0.0)))
        return self.sides[kind]


class Piece:
    """Some queries and the nearest rows found so far: place of the query, distance and row id, in this order."""

    def __init__(self, vectors: np.ndarray, k: int, metric: str):
        self.vectors, self.k, self.metric, self.kind = vectors, k, metric, np.float32
        self.squares = np.einsum("ij,ij->i", vectors, vectors)
        self.offset = self.squares if metric == "EUCLIDEAN" else np.full(len(vectors), 1.0 if metric == "COSINE" else 0.0)
        self.sides: dict[type, np.ndarray] = {}
        self.place, self.distance, self.ids = np.zeros(0, np.int64), np.zeros(0), np.zeros(0, np.int64)
        self.worst = np.full(len(vectors), np.inf)  # distance of the k-th

    def side(self) -> np.ndarray:
        if self.kind not in self.sides:
            scaled = self.vectors * (-2.0 if self.metric == "EUCLIDEAN" else -1.0)
            self.sides[self.kind] = np.column_stack([scaled, np.ones(len(scaled))]).astype(self.kind)
        return self.sides[self.kind]

    def screen(self, tile: Tile) -> tuple[np.ndarray, np.ndarray]:
        """Pairs (query, row) of which the row may be among the k nearest."""
        right, longest = tile.side(self.kind)
        product = self.side() @ right
        slack = UNIT[self.kind] * (self.vectors.shape[1] + 8) * (np.sqrt(self.squares) + longest) ** 2 + self.vectors.shape[1] * TINY[self.kind]
        slack += UNIT[np.float64] * np.abs(self.offset)  # products that differ may leave equal distances
        limit = self.worst - self.offset + slack
        unbound = np.flatnonzero(np.isinf(self.worst))
        if len(unbound) and product.shape[1] >= self.k:
            kth = np.partition(product[unbound], self.k - 1, axis=1)[:, self.k - 1]
            limit[unbound] = kth + 2 * slack[unbound]
        limit[np.isnan(limit) | ~(self.squares < LARGEST[self.kind])] = np.inf
        beyond = product > np.nextafter(limit.astype(self.kind), self.kind(np.inf))[:, None]
        return np.divmod(np.flatnonzero(np.logical_not(beyond, out=beyond)), product.shape[1])

    def add(self, tile: Tile) -> None:
        with np.errstate(all="ignore"):
            q, r = self.screen(tile)
            if self.kind is np.float32 and len(q) > 4 * self.k * len(self.vectors):
                self.kind = np.float64
                q, r = self.screen(tile)
            step = max(1, PAIR_VALUES // self.vectors.shape[1])
            d = np.concatenate([exact(self.vectors[q[i : i + step]], tile.vectors[r[i : i + step]], self.metric) for i in range(0, len(q), step)] or [np.zeros(0)])
            near = ~(d > self.worst[q])
        if near.any():
            self.merge(q[near], d[near], tile.ids[r[near]])

    def merge(self, place: np.ndarray, distance: np.ndarray, ids: np.ndarray) -> None:
        place, distance, ids = np.concatenate([self.place, place]), np.concatenate([self.distance, distance]), np.concatenate([self.ids, ids])
        order = np.lexsort((ids, distance, place))  # NaN comes last
        place, distance, ids = place[order], distance[order], ids[order]
        rank = np.arange(len(place)) - np.searchsorted(place, np.arange(len(self.vectors)))[place]
        kth = rank == self.k - 1
        self.worst[place[kth]] = np.where(np.isnan(distance[kth]), np.inf, distance[kth])
        kept = rank < self.k
        self.place, self.distance, self.ids = place[kept], distance[kept], ids[kept]


def nearest(queries: np.ndarray, blocks: Iterable[tuple[np.ndarray, np.ndarray]], k: int, metric: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Place of the query, row id and distance of the ``k`` nearest of all rows; ties follow ids."""
    pieces, seen = [Piece(queries[i : i + PIECE], k, metric) for i in range(0, len(queries), PIECE)], 0
    for ids, vectors in blocks:
        at = 0
        while at < len(ids):  # at first in small steps: each then has a few candidates for a query
            to = at + min(TILE, max(FIRST, 4 * k, seen))
            tile = Tile(ids[at:to], vectors[at:to], metric)
            for piece in pieces:
                piece.add(tile)
            seen, at = seen + len(tile.ids), to
    place = [p.place + i * PIECE for i, p in enumerate(pieces)]
    return tuple(np.concatenate(x) if x else np.zeros(0, t) for x, t in ((place, np.int64), ([p.ids for p in pieces], np.int64), ([p.distance for p in pieces], np.float64)))


def search(tasks: list[tuple[str, list[str]]], dimensions: int, k: int, metric: str, id_type: pa.DataType):
    """For mapInArrow over numbers of tasks, each a file of queries and files of rows,
    which have ids or have none: (query id, row id, distance)."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for n in (n for batch in batches for n in batch.column(0).to_pylist()):
            asked, files = tasks[n]
            found = list(read_blocks([asked], dimensions))
            if not found:
                continue
            names = pa.concat_arrays([ids for ids, _ in found]).cast(id_type)
            unnamed = False

            def rows(files: list[str] = files) -> Iterator[tuple[np.ndarray, np.ndarray]]:
                nonlocal unnamed
                for ids, vectors in read_blocks(files, dimensions):
                    unnamed = ids.null_count > 0
                    yield ids.fill_null(0).to_numpy(), vectors

            place, ids, distance = nearest(np.concatenate([v for _, v in found]), rows(), k, metric)
            yield pa.RecordBatch.from_arrays([names.take(pa.array(place)), pa.nulls(len(ids), pa.int64()) if unnamed else pa.array(ids), pa.array(distance)], names=["query", "row", "distance"])

    return run
