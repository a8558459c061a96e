"""Language-model scoring by context-tree weighting over bytes.

Every byte is eight binary decisions, each named by the bits before it (255 inner nodes of a
binary tree). For each of them there is a context tree over the preceding bytes, down to
``depth``. A node counts how often the decision was 0 and 1 in its context; its
Krichevsky-Trofimov probability is closed-form in the counts, and its weighted probability is
half of that plus half the product of its children's weighted probabilities. The weight that
a node keeps for itself, given the corpus, is the first half's share. A decision's probability
mixes the estimates of all depths along its path by these weights, and a text's code length
is the sum of -log2 over all its decisions.

Gathering. Tasks count (context, byte) grams of whole texts and one aggregation sums them:
what is shuffled is each task's distinct grams, in proportion to the input. Nodes of depth 2
and more are then weighed in partitions by the two latest bytes of context. Only depths 1 and
0 (at most 256 x 255 rows, whatever the corpus) pass through the driver. The nodes become a
sorted table in the shared folder.

Scoring. A task looks up the nodes of the grams it meets, by key range, and keeps code lengths
of grams in a direct-mapped cache of fixed size; no worker holds the whole table.

Defined cases. Before its first byte a text's context is zero bytes. A null text has null
results; the empty text has 0 bits and no rate. Contexts that the corpus lacks are left at
the depth they end (an unseen node's estimate is 1/2). An empty corpus scores 8 bits a byte.
Repeated rows count, and score, as often as they occur. Extra columns don't matter.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vectorframe.llm.shared import SortedTable, pieces, settle, shared_dir, text_bytes

#: Bytes of context.
DEPTH = 3
_CACHE_BITS = 21
_MIX = np.uint64(0x9E3779B97F4A7C15)


def grams(data: np.ndarray, offsets: np.ndarray, depth: int) -> np.ndarray:
    """For each byte its context and itself: latest context byte highest, the byte lowest."""
    place = np.arange(len(data)) - np.repeat(offsets[:-1], np.diff(offsets))  # bytes before it in its text
    out = data.astype(np.int64)
    for back in range(1, depth + 1):
        before = np.zeros(len(data), dtype=np.int64)
        before[back:] = data[:-back] if back < len(data) else 0
        before[place < back] = 0
        out |= before << (8 * (depth + 1 - back))
    return out


def _summed(keys: np.ndarray, *values: np.ndarray) -> tuple[np.ndarray, ...]:
    """Distinct keys, ascending, with the sums of their values."""
    if not len(keys):
        return keys, *values
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    first = np.flatnonzero(np.diff(keys, prepend=keys[0] - 1))
    return keys[first], *(np.add.reduceat(v[order], first) for v in values)


def _count(depth: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, counts = np.zeros(0, np.int64), np.zeros(0, np.int64)
        held: list[tuple[np.ndarray, np.ndarray]] = []
        for batch in batches:
            for piece in pieces(batch, "text"):
                g = np.sort(grams(*text_bytes(piece.column("text")), depth))
                if len(g):
                    first = np.flatnonzero(np.diff(g, prepend=-1))
                    held.append((g[first], np.diff(np.append(first, len(g)))))
                if sum(len(k) for k, _ in held) > 1 << 21:
                    keys, counts = _summed(*(np.concatenate(x) for x in zip((keys, counts), *held)))
                    held = []
                if len(keys) > 1 << 21:  # pass on what is there; the aggregation adds it up
                    yield pa.record_batch([pa.array(keys), pa.array(counts)], ["gram", "n"])
                    keys, counts = keys[:0], counts[:0]
        keys, counts = _summed(*(np.concatenate(x) for x in zip((keys, counts), *held)))
        yield pa.record_batch([pa.array(keys), pa.array(counts)], ["gram", "n"])

    return run


def _log_gamma(x: np.ndarray) -> np.ndarray:
    """Stirling's series after eight steps of the recurrence; within 1e-11 for x of 1/2 and more."""
    product, y = np.ones_like(x), x.copy()
    for _ in range(8):
        product = product * y
        y = y + 1
    r = 1 / y
    s = r * r
    return (y - 0.5) * np.log(y) - y + 0.5 * np.log(2 * np.pi) + r * (1 / 12 - s * (1 / 360 - s * (1 / 1260 - s / 1680))) - np.log(product)


def log_kt(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Natural logarithm of the Krichevsky-Trofimov probability of ``a`` zeros and ``b`` ones."""
    a, b = a.astype(float), b.astype(float)
    return _log_gamma(a + 0.5) + _log_gamma(b + 0.5) - np.log(np.pi) - _log_gamma(a + b + 1)


def decisions(gram: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(n, 8) keys of the decisions of each gram, context above an inner node's 8 bits, and their outcomes."""
    byte, step = gram & 255, np.arange(8)
    node = (1 << step) | (byte[:, None] >> (8 - step))
    return (gram[:, None] >> 8 << 8) | node, (byte[:, None] >> (7 - step)) & 1


def _key(depth: int, node: np.ndarray) -> np.ndarray:
    return (np.int64(depth) << 56) | node


def weigh(node: np.ndarray, a: np.ndarray, b: np.ndarray, below: np.ndarray | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Log weighted probability, own weight and estimate of a 1, from counts and the children's summed log probabilities."""
    own = log_kt(a, b)
    if below is None:  # deepest nodes
        total, weight = own, np.ones(len(node))
    else:
        total = np.logaddexp(own, below) - np.log(2)
        weight = np.exp(own - np.logaddexp(own, below))
    return total, weight, (b + 0.5) / (a + b + 1.0)


def _weigh_partition(depth: int):
    """Grams of whole two-byte contexts -> nodes of depths ``depth`` down to 2."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = [(b.column("gram").to_numpy(), b.column("n").to_numpy()) for b in batches if b.num_rows]
        if not parts:
            return
        gram, n = (np.concatenate(x) for x in zip(*parts))
        keys, bits = decisions(gram)
        n = np.repeat(n, 8)
        node, a, b = _summed(keys.ravel(), n * (1 - bits.ravel()), n * bits.ravel())
        below = None
        for d in range(depth, 1, -1):
            total, weight, one = weigh(node, a, b, below)
            for at in range(0, len(node), 1 << 18):
                cut = slice(at, at + (1 << 18))
                yield pa.record_batch([pa.array(x[cut]) for x in (_key(d, node), np.full(len(node), d, np.int32), node, a, b, total, weight, one)], ["key", "depth", "node", "a", "b", "total", "weight", "one"])
            parent = (node >> 16 << 8) | (node & 255)  # the earliest context byte goes
            node, a, b, below = _summed(parent, a, b, total)

    return run


def train(docs: DataFrame, text: str = "text", depth: int = DEPTH) -> str:
    """Weigh the trees of all texts; the URI of the table of nodes (key, weight, one)."""
    if not 2 <= depth <= 5:
        raise ValueError("depth must be from 2 to 5")
    spark = docs.sparkSession
    folder, partitions = shared_dir(spark, "ctw"), int(spark.conf.get("spark.sql.shuffle.partitions"))
    counted = docs.where(F.col(text).isNotNull()).select(F.col(text).alias("text")).mapInArrow(_count(depth), "gram long, n long")
    sums = counted.groupBy("gram").agg(F.sum("n").alias("n"))
    whole = sums.repartition(partitions, F.shiftrightunsigned("gram", 8 * (depth - 1)))
    nodes = settle(whole.mapInArrow(_weigh_partition(depth), "key long, depth int, node long, a long, b long, total double, weight double, one double"), f"{folder}/deep")
    # at most 256 x 255 rows, one for each latest byte and decision
    rows = nodes.where("depth = 2").groupBy(F.expr("(node >> 16 << 8) | (node & 255)").alias("node")).agg(*[F.sum(c).alias(c) for c in ("a", "b", "total")]).orderBy("node").toPandas()
    node, a, b, below = (rows[c].to_numpy() for c in ("node", "a", "b", "total"))
    shallow = []
    for d in (1, 0):
        total, weight, one = weigh(node, a, b, below)
        shallow += zip(_key(d, node).tolist(), weight.tolist(), one.tolist())
        node, a, b, below = _summed((node >> 16 << 8) | (node & 255), a, b, total)
    top = spark.createDataFrame(shallow, "key long, weight double, one double")
    SortedTable.write(nodes.select("key", "weight", "one").unionByName(top), f"{folder}/nodes", partitions)
    return f"{folder}/nodes"


class Scorer:
    """Code lengths of grams from a table of nodes."""

    def __init__(self, uri: str, depth: int):
        self.table, self.depth = SortedTable(uri), depth
        self.keys = np.full(1 << _CACHE_BITS, -1, dtype=np.int64)
        self.bits = np.zeros(1 << _CACHE_BITS, dtype=np.float64)

    def _compute(self, gram: np.ndarray) -> np.ndarray:
        keys, bits = decisions(gram)
        one = np.full(keys.shape, 0.5)
        for d in range(self.depth, -1, -1):
            k = keys >> (8 * (self.depth - d + 1)) << 8 | (keys & 255)
            distinct, where = np.unique(_key(d, k), return_inverse=True)
            there, (weight, estimate) = self.table.lookup(distinct)
            weight, estimate = np.where(there, weight, 1.0), np.where(there, estimate, 0.5)
            one = (weight * estimate)[where].reshape(keys.shape) + (1 - weight)[where].reshape(keys.shape) * one
        return -np.log2(np.where(bits == 1, one, 1 - one)).sum(axis=1)

    def lengths(self, gram: np.ndarray) -> np.ndarray:
        slot = ((gram.astype(np.uint64) * _MIX) >> np.uint64(64 - _CACHE_BITS)).astype(np.int64)
        out = self.bits[slot]
        missed = np.flatnonzero(self.keys[slot] != gram)
        if len(missed):
            new, where = np.unique(gram[missed], return_inverse=True)
            bits = np.concatenate([self._compute(new[i : i + 50_000]) for i in range(0, len(new), 50_000)])
            out[missed] = bits[where]
            at = ((new.astype(np.uint64) * _MIX) >> np.uint64(64 - _CACHE_BITS)).astype(np.int64)
            self.keys[at] = new  # of several grams at a slot the last stays, in both arrays
            self.bits[at] = bits
        return out


_scorers: dict[str, Scorer] = {}


def _score(uri: str, depth: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if uri not in _scorers:
            _scorers.clear()
            _scorers[uri] = Scorer(uri, depth)
        for batch in batches:
            for piece in pieces(batch, "text"):
                column = piece.column("text")
                data, offsets = text_bytes(column)
                sums = np.zeros(len(data) + 1)
                np.cumsum(_scorers[uri].lengths(grams(data, offsets, depth)), out=sums[1:])
                size, bits = np.diff(offsets), np.diff(sums[offsets])
                null = column.is_null().to_numpy(zero_copy_only=False)
                rate = np.divide(bits, size, out=np.zeros(len(size)), where=size > 0)
                yield pa.record_batch([piece.column("doc_id"), pa.array(size, mask=null), pa.array(bits, mask=null), pa.array(rate, mask=null | (size == 0))], ["doc_id", "n_bytes", "bits", "bits_per_byte"])

    return run


def score(docs: DataFrame, uri: str, id_column: str = "doc_id", text: str = "text", depth: int = DEPTH) -> DataFrame:
    """(doc_id, n_bytes, bits, bits_per_byte) of every row under the model at ``uri``."""
    narrow = docs.select(F.col(id_column).alias("doc_id"), F.col(text).alias("text"))
    schema = T.StructType([narrow.schema["doc_id"], T.StructField("n_bytes", T.LongType()), T.StructField("bits", T.DoubleType()), T.StructField("bits_per_byte", T.DoubleType())])
    return narrow.mapInArrow(_score(uri, depth), schema)
