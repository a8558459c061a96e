"""Exact deduplication by an extendible-hash index kept on shared files.

1. Every text is hashed in the JVM; only (hash, count) pairs are shuffled, to owner tasks
   that each hold a range of the hash space. An owner inserts its keys into an
   extendible-hash index (overfull buckets split, the directory doubles when a bucket at
   full depth splits, equal keys chain) and writes the index of the keys that more than one
   text has to the shared folder. Files are replaced whole, so a retried task is harmless.
2. Documents are read again. Each batch of hashes is probed against the index; a text whose
   key has no chain is unique and goes no further, without any shuffle of its text.
3. Texts on chains are folded inside their task (equal bytes become one row), sent to the
   owner of their key, and compared there byte by byte, so hash collisions never merge
   different texts. A text with many copies crosses the network about once for each task.

Defined cases. A null text is unknown, equals nothing and is kept; the empty text is a text
like any other. The copy kept is the one with the smallest ``doc_id`` (nulls last); among
rows that share it, one. A repeated row is a duplicate of its own id. An empty table gives an
empty result. Extra columns pass through untouched, whatever their names.
"""

from __future__ import annotations

import io
from collections import OrderedDict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vectorframe.llm.shared import fresh, pieces, read_bytes, settle, shared_dir, write_bytes

#: Keys in a bucket before it splits.
BUCKET_CAPACITY = 512
#: Most doublings of an owner's directory; a bucket that is overfull at this depth just grows.
MAX_DEPTH = 20
#: Bytes of index pages that a worker keeps.
PAGE_CACHE_BYTES = 256 << 20
#: Text bytes that are folded, or compared, at once in a task.
FOLD_BYTES = 4 << 20


class ExtendibleHash:
    """Extendible hash table over uint64 keys, addressed by their bits after ``skip``."""

    def __init__(self, skip: int = 0, capacity: int = BUCKET_CAPACITY):
        self.skip, self.capacity, self.depth = skip, capacity, 0
        self.directory = np.zeros(1, dtype=np.int32)
        self.local, self.prefix = [0], [0]
        self.keys: list[np.ndarray] = [np.zeros(0, np.uint64)]
        self.counts: list[np.ndarray] = [np.zeros(0, np.int64)]

    def _slot(self, keys: np.ndarray, depth: int) -> np.ndarray:
        if not depth:
            return np.zeros(len(keys), dtype=np.int64)
        return ((keys << np.uint64(self.skip)) >> np.uint64(64 - depth)).astype(np.int64)

    def insert(self, keys: np.ndarray, counts: np.ndarray) -> None:
        """Add ``counts`` to the chains of ``keys``."""
        if not len(keys):
            return
        bucket = self.directory[self._slot(keys, self.depth)]
        order = np.argsort(bucket, kind="stable")
        bucket, keys, counts = bucket[order], keys[order], counts[order]
        cuts = np.flatnonzero(np.diff(bucket, prepend=-1))
        for a, b in zip(cuts, [*cuts[1:], len(keys)]):
            at = int(bucket[a])
            k, where = np.unique(np.concatenate([self.keys[at], keys[a:b]]), return_inverse=True)
            n = np.bincount(where, weights=np.concatenate([self.counts[at], counts[a:b]]), minlength=len(k))
            self.keys[at], self.counts[at] = k, n.astype(np.int64)
            self._split(at)

    def _split(self, at: int) -> None:
        todo = [at]
        while todo:
            at = todo.pop()
            if len(self.keys[at]) <= self.capacity or self.local[at] >= MAX_DEPTH:
                continue
            if self.local[at] == self.depth:
                self.directory = np.repeat(self.directory, 2)
                self.depth += 1
            depth = self.local[at] + 1
            high = (self._slot(self.keys[at], depth) & 1).astype(bool)
            new = len(self.keys)
            self.keys.append(self.keys[at][high])
            self.counts.append(self.counts[at][high])
            self.keys[at], self.counts[at] = self.keys[at][~high], self.counts[at][~high]
            self.local[at] = depth
            self.local.append(depth)
            self.prefix[at] *= 2
            self.prefix.append(self.prefix[at] + 1)
            span = self.depth - depth
            self.directory[self.prefix[new] << span : (self.prefix[new] + 1) << span] = new
            todo += [at, new]

    def chained(self) -> ExtendibleHash:
        """The index of the keys that have more than one entry."""
        out = ExtendibleHash(self.skip, self.capacity)
        keys, counts = np.concatenate(self.keys), np.concatenate(self.counts)
        out.insert(keys[counts > 1], counts[counts > 1])
        return out

    def dump(self) -> bytes:
        starts = np.concatenate([[0], np.cumsum([len(k) for k in self.keys])]).astype(np.int64)
        np.savez(out := io.BytesIO(), directory=self.directory, starts=starts, keys=np.concatenate(self.keys), shape=np.array([self.skip, self.depth]))
        return out.getvalue()


class Pages:
    """A dumped index, for look-ups."""

    def __init__(self, data: bytes):
        z = np.load(io.BytesIO(data))
        self.directory, self.starts, self.keys = z["directory"], z["starts"], z["keys"]
        self.skip, self.depth = map(int, z["shape"])
        self.size = self.directory.nbytes + self.starts.nbytes + self.keys.nbytes

    def contains(self, keys: np.ndarray) -> np.ndarray:
        """Binary search of every key in the page its directory slot points to."""
        slot = ((keys << np.uint64(self.skip)) >> np.uint64(64 - self.depth)).astype(np.int64) if self.depth else np.zeros(len(keys), np.int64)
        page = self.directory[slot]
        low, end = self.starts[page], self.starts[page + 1]
        high = end.copy()
        if not len(self.keys):
            return np.zeros(len(keys), dtype=bool)
        while (open_ := low < high).any():
            middle = (low + high) // 2
            less = open_ & (self.keys[np.minimum(middle, len(self.keys) - 1)] < keys)
            low = np.where(less, middle + 1, low)
            high = np.where(open_ & ~less, middle, high)
        return (low < end) & (self.keys[np.minimum(low, len(self.keys) - 1)] == keys)


class Opened:
    """Pages of all owners (chained keys alone) of an index; those used last are kept, up to a bound."""

    def __init__(self, uri: str):
        self.uri, self.kept = uri, OrderedDict()

    def of(self, owner: int) -> Pages:
        kept = self.kept
        if owner not in kept:
            kept[owner] = Pages(read_bytes(f"{self.uri}/owner-{owner:06d}.npz"))
            while len(kept) > 1 and sum(p.size for p in kept.values()) > PAGE_CACHE_BYTES:
                kept.popitem(last=False)
        kept.move_to_end(owner)
        return kept[owner]


def _owner_bits(df: DataFrame) -> int:
    partitions = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return min(16, max(1, (partitions - 1).bit_length()))


def text_key(text: Column) -> Column:
    return F.xxhash64(text)


def build_index(docs: DataFrame, uri: str, text: str = "text") -> int:
    """Write the index of the texts of ``docs`` below ``uri``; the number of owner bits.

    Partial counts leave each task, so a text with many copies is one row from a task.
    """
    bits = _owner_bits(docs)
    keys = docs.where(F.col(text).isNotNull()).select(text_key(F.col(text)).alias("h")).groupBy("h").agg(F.count(F.lit(1)).alias("n"))
    owned = keys.repartition(1 << bits, F.shiftrightunsigned("h", 64 - bits))

    def own(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables: dict[int, ExtendibleHash] = {}
        for b in batches:
            h, n = b.column(0).to_numpy().view(np.uint64), b.column(1).to_numpy()
            mine = (h >> np.uint64(64 - bits)).astype(np.int64)
            for o in np.unique(mine):
                tables.setdefault(int(o), ExtendibleHash(bits)).insert(h[mine == o], n[mine == o])
        for o, table in tables.items():
            write_bytes(f"{uri}/owner-{o:06d}.npz", table.chained().dump())
        yield pa.record_batch([pa.array(list(tables), pa.int64())], ["owner"])

    made = {r.owner for r in owned.mapInArrow(own, "owner long").collect()}  # one number for each owner
    empty = ExtendibleHash(bits).dump()
    for o in set(range(1 << bits)) - made:
        write_bytes(f"{uri}/owner-{o:06d}.npz", empty)
    return bits


def on_chain(uri: str, bits: int):
    """Arrow UDF: whether the index has a chain for a key."""

    @F.arrow_udf(T.BooleanType())
    def probe(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        pages = Opened(uri)
        for h in batches:
            keys = h.to_numpy(zero_copy_only=False).view(np.uint64)
            owner = (keys >> np.uint64(64 - bits)).astype(np.int64)
            found = np.zeros(len(keys), dtype=bool)
            order = np.argsort(owner, kind="stable")
            cuts = np.flatnonzero(np.diff(owner[order], prepend=-1))
            for a, b in zip(cuts, [*cuts[1:], len(keys)]):
                at = order[a:b]
                found[at] = pages.of(int(owner[at[0]])).contains(keys[at])
            yield pa.array(found)

    return probe


def _fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (h, doc_id, text, row) -> one row for each distinct text: (h, doc_id, ids, text, row)
    with the smallest id first and the row that has it. Texts are held until they, or their ids,
    are many."""
    groups: dict[tuple[int, str], list] = {}
    held = 0

    def folded(schema: pa.Schema) -> pa.RecordBatch:
        ids = schema.field("doc_id").type
        columns = {"h": pa.array([k[0] for k in groups], pa.int64()), "doc_id": pa.array([g[0] for g in groups.values()], ids), "ids": pa.array([g[1] for g in groups.values()], pa.list_(ids)), "text": pa.array([k[1] for k in groups], pa.string())}
        rows = [g[2] for g in groups.values()]
        columns["row"] = pa.concat_arrays(rows) if rows else pa.array([], schema.field("row").type)
        return pa.record_batch(list(columns.values()), list(columns))

    schema = None
    for batch in batches:
        schema = batch.schema
        for b in pieces(batch, "text", FOLD_BYTES):
            row = b.column("row")
            for n, (h, i, text) in enumerate(zip(*(b.column(c).to_pylist() for c in ("h", "doc_id", "text")))):
                if (g := groups.get((h, text))) is None:
                    groups[h, text] = [i, [i], row.take(pa.array([n]))]
                    held += len(text) + 100
                    continue
                g[1].append(i)
                held += 8
                if i is not None and (g[0] is None or i < g[0]):
                    g[0], g[2] = i, row.take(pa.array([n]))
            if held > FOLD_BYTES:
                yield folded(schema)
                groups.clear()
                held = 0
    if groups:
        yield folded(schema)


def _chains(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, list, list, list]]:
    """Rows of an owner, by key and smallest id: pieces with ids, what they duplicate, and the
    positions of first copies."""
    key, texts = None, {}
    for batch in batches:
        for b in pieces(batch, "text", FOLD_BYTES):
            ids, of, first = [], [], []
            for n, (h, i, more, text) in enumerate(zip(*(b.column(c).to_pylist() for c in ("h", "doc_id", "ids", "text")))):
                if h != key:
                    key, texts = h, {}
                if text not in texts:  # equal keys chain; bytes decide
                    texts[text] = i
                    first.append(n)
                    more.remove(i)
                ids += more
                of += [texts[text]] * len(more)
            yield b, ids, of, first


def _resolve_pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b, ids, of, _ in _chains(batches):
        kind = b.schema.field("doc_id").type
        yield pa.record_batch([pa.array(ids, kind), pa.array(of, kind)], ["doc_id", "duplicate_of"])


def _resolve_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b, _, _, first in _chains(batches):
        at = pa.array(first, pa.int64())
        yield pa.record_batch([b.column("text").take(at), b.column("row").take(at)], ["text", "row"])


def _owned(docs: DataFrame, folder: str, h: str, id_column: str, text: str, row: Column, bits: int) -> DataFrame:
    """Folded chain texts at their owners, by key and smallest id.

    The texts on chains are settled first: a task that probed them and folded them would keep
    two Python workers at once.
    """
    packed = settle(docs.select(F.col(h).alias("h"), F.col(id_column).alias("doc_id"), F.col(text).alias("text"), row.alias("row")), f"{folder}/chains")
    kind = {f.name: f.dataType for f in packed.schema}
    schema = T.StructType([T.StructField("h", T.LongType()), T.StructField("doc_id", kind["doc_id"]), T.StructField("ids", T.ArrayType(kind["doc_id"])), T.StructField("text", T.StringType()), T.StructField("row", kind["row"])])
    folded = packed.mapInArrow(_fold, schema)
    return folded.repartition(1 << bits, F.shiftrightunsigned("h", 64 - bits)).sortWithinPartitions("h", F.col("doc_id").asc_nulls_last())


def _probed(docs: DataFrame, text: str) -> tuple[DataFrame, str, str, str, int]:
    uri = shared_dir(docs.sparkSession, "exact")
    bits = build_index(docs, uri, text)
    h, chain = fresh(docs, "key"), fresh(docs, "chain")
    probed = docs.withColumn(h, text_key(F.col(text))).withColumn(chain, on_chain(uri, bits)(F.col(h)) & F.col(text).isNotNull())
    return probed, uri, h, chain, bits


def exact_duplicates(docs: DataFrame, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, duplicate_of) of every row whose text an earlier row has; see the module."""
    probed, folder, h, chain, bits = _probed(docs.select(F.col(id_column), F.col(text)), text)
    owned = _owned(probed.where(F.col(chain)), folder, h, id_column, text, F.lit(None).cast("boolean"), bits)
    kind = owned.schema["doc_id"].dataType
    return owned.drop("row").mapInArrow(_resolve_pairs, T.StructType([T.StructField("doc_id", kind), T.StructField("duplicate_of", kind)]))


def drop_exact_duplicates(docs: DataFrame, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with one row of each text; rows with unique or null texts aren't shuffled."""
    probed, folder, h, chain, bits = _probed(docs, text)
    others = [c for c in docs.columns if c != text]
    rows = F.struct(*[F.col(f"`{c}`") for c in others]) if others else F.lit(None).cast("boolean")
    owned = _owned(probed.where(F.col(chain)), folder, h, id_column, text, rows, bits)
    kept = owned.mapInArrow(_resolve_rows, T.StructType([T.StructField("text", T.StringType()), owned.schema["row"]]))
    same = kept.select(*[F.col("text").alias(c) if c == text else F.col(f"row.`{c}`") for c in docs.columns])
    return probed.where(~F.col(chain)).select(*[F.col(f"`{c}`") for c in docs.columns]).unionByName(same)
