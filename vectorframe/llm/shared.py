"""What the operators of this subpackage share: the cluster's shared folder, sorted
tables kept there, and vectorised work on the bytes of Arrow string columns.

Nothing here holds a whole table on one machine: tables in the shared folder are read
shard by shard, and text is cut into pieces of a few megabytes at row boundaries.
"""

from __future__ import annotations

import json
import tempfile
import uuid
from collections import OrderedDict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Text bytes worked on at once in a Python worker; a longer document is a piece of its own.
PIECE_BYTES = 1 << 19


# ---------------------------------------------------------------- shared folder


def shared_dir(spark: SparkSession, name: str) -> str:
    """URI of a new folder below ``spark.checkpoint.dir``, which every executor can read.

    Where the setting is missing, a temporary folder is made and the setting filled in;
    this is done for a local master alone, where driver and executors are one machine.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        master = spark.conf.get("spark.master", "local")
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="shared-")
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def small_batches(spark: SparkSession) -> None:
    """Have rows with whole texts go to Python a few megabytes at a time, if the session still has
    the usual number of rows; results don't depend on it."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(name) == "10000":
        spark.conf.set(name, "2000")


def filesystem(uri: str) -> tuple[pafs.FileSystem, str]:
    """Arrow file system and path of a URI (plain paths are local; s3a is read as s3)."""
    if "://" not in uri and not uri.startswith("file:"):
        return pafs.LocalFileSystem(), uri
    return pafs.FileSystem.from_uri(uri.replace("s3a://", "s3://", 1))


def write_bytes(uri: str, data: bytes) -> None:
    """Write a file under a name of its own, then move it: a retried task can't tear it."""
    fs, path = filesystem(uri)
    fs.create_dir(path.rpartition("/")[0], recursive=True)
    temporary = f"{path}.{uuid.uuid4().hex}"
    with fs.open_output_stream(temporary) as out:
        out.write(data)
    fs.move(temporary, path)


def read_bytes(uri: str) -> bytes:
    fs, path = filesystem(uri)
    with fs.open_input_stream(path) as src:
        return src.read()


def settle(df: DataFrame, uri: str) -> DataFrame:
    """Cut lineage: write ``df`` as a table in the shared folder and read it back."""
    df.write.mode("overwrite").parquet(uri)
    return df.sparkSession.read.schema(df.schema).parquet(uri)


def fresh(df: DataFrame, base: str) -> str:
    """A column name that ``df`` doesn't have, whatever the case."""
    taken, name = {c.lower() for c in df.columns}, f"__{base}"
    while name.lower() in taken:
        name += "_"
    return name


# ---------------------------------------------------------------- sorted tables


class SortedTable:
    """Key -> float columns, as Parquet files in the shared folder, each sorted by ``key``
    and covering a key range of its own.

    ``write`` is distributed; a worker opens the table by its manifest and loads the files
    that its (sorted) keys fall into, keeping at most ``cache_bytes`` of them.
    """

    def __init__(self, uri: str, cache_bytes: int = 192 << 20):
        manifest = json.loads(read_bytes(f"{uri}/manifest.json"))
        self.uri, self.columns, self.cache_bytes = uri, manifest["columns"], cache_bytes
        self.low = np.array([f["low"] for f in manifest["files"]], dtype=np.int64)
        self.files = [f["file"] for f in manifest["files"]]
        self.cache: OrderedDict[int, tuple[np.ndarray, list[np.ndarray]]] = OrderedDict()

    @staticmethod
    def write(df: DataFrame, uri: str, partitions: int) -> None:
        """``df`` has a unique, non-null bigint ``key``; its other columns are doubles."""
        columns = [c for c in df.columns if c != "key"]
        data = f"{uri}/data"
        df.repartitionByRange(partitions, "key").sortWithinPartitions("key").write.mode("overwrite").parquet(data)
        spark = df.sparkSession
        stats = (
            spark.read.schema(df.schema).parquet(data).groupBy(F.col("_metadata.file_name").alias("file"))
            .agg(F.min("key").alias("low")).orderBy("low").collect()
        )  # one row for each file, not for each key
        write_bytes(f"{uri}/manifest.json", json.dumps({"columns": columns, "files": [r.asDict() for r in stats]}).encode())

    def _load(self, i: int) -> tuple[np.ndarray, list[np.ndarray]]:
        if i in self.cache:
            self.cache.move_to_end(i)
            return self.cache[i]
        fs, path = filesystem(f"{self.uri}/data/{self.files[i]}")
        t = pq.read_table(path, filesystem=fs, use_threads=False)
        found = (t["key"].to_numpy(), [t[c].to_numpy() for c in self.columns])
        self.cache[i] = found
        while len(self.cache) > 1 and sum(k.nbytes + sum(v.nbytes for v in vs) for k, vs in self.cache.values()) > self.cache_bytes:
            self.cache.popitem(last=False)
        return found

    def lookup(self, keys: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
        """For ascending int64 ``keys``: whether each is there, and its values (NaN if not)."""
        there = np.zeros(len(keys), dtype=bool)
        values = [np.full(len(keys), np.nan) for _ in self.columns]
        if not len(keys) or not len(self.low):
            return there, values
        shard = np.searchsorted(self.low, keys, side="right") - 1
        cuts = np.flatnonzero(np.diff(shard, prepend=shard[0] - 1))
        for a, b in zip(cuts, [*cuts[1:], len(keys)]):
            if shard[a] < 0:
                continue
            k, vs = self._load(int(shard[a]))
            at = np.minimum(np.searchsorted(k, keys[a:b]), len(k) - 1)
            hit = k[at] == keys[a:b]
            there[a:b] = hit
            for out, v in zip(values, vs):
                out[a:b][hit] = v[at[hit]]
        return there, values


# ---------------------------------------------------------------- bytes of text


def pieces(batch: pa.RecordBatch, column: str, limit: int = PIECE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut a batch at row boundaries so that ``column`` has about ``limit`` bytes in each."""
    if not batch.num_rows:
        return
    _, offsets = text_bytes(batch.column(column))
    start = 0
    while start < batch.num_rows:
        end = int(np.searchsorted(offsets, offsets[start] + limit, side="right")) - 1
        end = min(max(end, start + 1), batch.num_rows)
        yield batch.slice(start, end - start)
        start = end


def text_bytes(array: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of a string column, and offsets into them; a null has no bytes."""
    if array.type != pa.large_string():
        array = array.cast(pa.large_string())
    if array.null_count:
        array = array.fill_null("")
    _, off, data = array.buffers()
    offsets = np.frombuffer(off, dtype=np.int64, count=array.offset + len(array) + 1)[array.offset :]
    whole = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    return whole[offsets[0] : offsets[-1]], offsets - offsets[0]


_BASE = np.uint64(0x9E3779B97F4A7C15)  # odd, so that it has an inverse modulo 2**64
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))
_powers: list[np.ndarray] = [np.zeros(0, np.uint64), np.zeros(0, np.uint64)]


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers[0]) < n:
        size = max(n, PIECE_BYTES + (1 << 16))
        for i, base in enumerate((_BASE, _INVERSE)):
            steps = np.full(size, base, dtype=np.uint64)
            steps[0] = 1
            _powers[i] = np.cumprod(steps, dtype=np.uint64)
    return _powers[0], _powers[1]


def mix64(x: np.ndarray) -> np.ndarray:
    """Finaliser that spreads every input bit over the 64 output bits."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def row_keys(h: np.ndarray, row: np.ndarray) -> np.ndarray:
    """Sort keys that bring equal (row, hash) side by side. The rows' part is moved away from the
    hashes of short words, which are ``mix64`` of small numbers too."""
    return mix64(h + mix64(row.astype(np.uint64) + np.uint64(0xD1B54A32D192ED03)))


#: True for bytes inside words: ASCII letters and digits, and all bytes of other letters.
WORD_BYTE = np.array([chr(i).isalnum() if i < 128 else True for i in range(256)])


def word_spans(data: np.ndarray, offsets: np.ndarray, inside: np.ndarray = WORD_BYTE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and row of each maximal run of ``inside`` bytes; no word crosses a row."""
    n = len(data)
    if not n:
        z = np.zeros(0, np.int64)
        return z, z, z
    flag = inside[data]
    edge = np.zeros(n + 1, dtype=bool)
    edge[offsets] = True
    before = np.empty(n, dtype=bool)
    before[0] = False
    before[1:] = flag[:-1]
    start = np.flatnonzero(flag & (~before | edge[:-1]))
    after = np.empty(n, dtype=bool)
    after[-1] = False
    after[:-1] = flag[1:]
    end = np.flatnonzero(flag & (~after | edge[1:])) + 1
    row = np.searchsorted(offsets, start, side="right") - 1
    return start, end, row


def span_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hash of the bytes of each span; equal bytes give equal hashes anywhere."""
    up, down = _power_tables(len(data) + 1)
    prefix = np.zeros(len(data) + 1, dtype=np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[: len(data)], out=prefix[1:])
    return mix64((prefix[end] - prefix[start]) * down[start] + (end - start).astype(np.uint64))


def row_sums(values: np.ndarray, row: np.ndarray, rows: int) -> np.ndarray:
    """Sum of values of each row (0 where a row has none)."""
    return np.bincount(row, weights=values, minlength=rows)[:rows]
