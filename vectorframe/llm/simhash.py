"""SimHash near-duplicates: pigeonhole blocks, then Hamming distance.

Fingerprint. 256 bits; each bit is the sign of a weighted vote of the text's distinct words
(lower case, punctuation dropped), a word's weight growing with its length up to eight
bytes, since short words are common to all texts of a language.

Candidates. The bits are split into ``max_distance`` + 1 disjoint blocks, so two fingerprints
within the distance agree on some block for certain (pigeonhole), at every size of the corpus.
Each fingerprint goes to the bucket of each of its blocks; no bucket and no list of partners is
capped. Texts with the same fingerprint are one node from the start, so copies never meet in a
bucket.

Buckets. Blocks lie in groups of six, and a pair within the distance has a group that differs in
five bits or fewer (the same principle), of which some block is then equal: rows of a bucket are
held against each other by the few words of its group alone, and in full only if these are close.
Large buckets are divided once more by the group's other blocks, and buckets above
``bucket_rows`` are dealt to several tasks, every two rows meeting in one. What a task puts out
is one edge for each pair, in the first bucket that it can be found in; rows near a common row of
the bucket are joined to that one alone, which keeps large families linear.

Groups are the connected components of the verified pairs; the row with the smallest id
(nulls last) stays.

Defined cases. A text without words (null, empty, punctuation alone) has no fingerprint, is
compared with nothing and stays. Repeated rows are near duplicates of themselves; one stays.
An empty table gives an empty result. Extra columns pass through, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vectorframe.llm.shared import SortedTable, fresh, mix64, pieces, row_keys, settle, shared_dir, span_hashes, text_bytes, word_spans

BITS = 256
#: Differing bits of 256 that still make a near duplicate. Of pairs of documents that share 0.85
#: of their distinct words or more, 0.99 are within it.
MAX_DISTANCE = 41
#: Blocks of a group, and most bits of a block that its key has.
GROUP, _KEY_BITS = 6, 40
#: Rows of a bucket above which its rows are dealt to several tasks.
BUCKET_ROWS = 1 << 18
#: Rows of a bucket above which it is divided further before rows are compared.
_LARGE = 1 << 16
#: Rows that are held against a whole bucket first, and rows near one of them that make a family.
_LEADERS, _FAMILY = 64, 64
#: Fingerprints packed at once; pairs compared at once, and columns of these.
_PACK_ROWS, _TILE, _TILE_COLUMNS = 1 << 11, 1 << 17, 4096
#: Features voted on at once.
_CHUNK = 1 << 15


def fingerprints(text: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(n, 4) uint64 fingerprints of a string column, and whether each text has words."""
    n = len(text)
    data, offsets = text_bytes(pc.utf8_lower(text))
    start, end, row = word_spans(data, offsets)
    out, some = np.zeros((n, BITS // 64), dtype=np.uint64), np.zeros(n, dtype=bool)
    if not len(start):
        return out, some
    h = span_hashes(data, start, end)
    order = np.argsort(row_keys(h, row))  # equal (row, word) side by side
    h, row, size = h[order], row[order], (end - start)[order]
    new = np.ones(len(h), dtype=bool)
    new[1:] = (h[1:] != h[:-1]) | (row[1:] != row[:-1])
    h, row, size = h[new], row[new], size[new]
    order = np.argsort(row, kind="stable")
    h, row, weight = h[order], row[order], np.clip(size[order], 2, 8).astype(np.int16) - 1
    votes = np.zeros((n, BITS), dtype=np.int64)
    for a in range(0, len(h), _CHUNK):
        hh, rr, w = h[a : a + _CHUNK], row[a : a + _CHUNK], weight[a : a + _CHUNK]
        first = np.flatnonzero(np.diff(rr, prepend=-1))
        total = np.add.reduceat(w.astype(np.int64), first)
        for lane in range(BITS // 64):
            bits = np.unpackbits(mix64(hh + np.uint64(0x5851F42D4C957F2D * (lane + 1) % (1 << 64))).view(np.uint8).reshape(-1, 8), axis=1)
            yes = np.add.reduceat(bits * w[:, None], first, axis=0, dtype=np.int32)
            votes[rr[first], lane * 64 : lane * 64 + 64] += 2 * yes - total[:, None]
    some[row] = True
    return np.packbits(votes > 0, axis=1).view(np.uint64), some


@F.arrow_udf(T.BinaryType())
def fingerprint(text: pa.Array) -> pa.Array:
    """32-byte fingerprint; null for a text without words."""
    batch, out = pa.record_batch([text], ["text"]), []
    for piece in pieces(batch, "text"):
        bits, some = fingerprints(piece.column(0))
        raw = bits.tobytes()
        out += [raw[i * 32 : i * 32 + 32] if ok else None for i, ok in enumerate(some)]
    return pa.array(out, pa.binary())


@dataclass(frozen=True)
class Block:
    """Bits of one block that make its key, and of its group: all others, and those of each other block."""

    key: np.ndarray
    group: int
    rest: np.ndarray
    others: tuple[np.ndarray, ...]
    after: int  # how many of ``others`` come before it


@dataclass(frozen=True)
class Plan:
    """Blocks of a distance: one more than it has bits, in groups of ``GROUP`` at most."""

    blocks: tuple[Block, ...]
    #: Block edges as bit positions, and for each group its first and last block.
    groups: tuple[tuple[int, int], ...]
    bits: tuple[np.ndarray, ...]

    def slack(self, group: int) -> int:
        """Differing bits that a group may have at most to have an equal block for certain."""
        low, high = self.groups[group]
        return high - low - 1


def plan_blocks(max_distance: int = MAX_DISTANCE) -> Plan:
    """``max_distance`` + 1 disjoint blocks of all bits. Whatever the number of fingerprints: the
    distance alone decides."""
    if not 0 <= max_distance < BITS:
        raise ValueError(f"max_distance must be from 0 to {BITS - 1}")
    bits = tuple(np.array_split(np.arange(BITS), max_distance + 1))
    groups = tuple((at, min(at + GROUP, len(bits))) for at in range(0, len(bits), GROUP))
    blocks = []
    for g, (low, high) in enumerate(groups):
        for i in range(low, high):
            key = bits[i][:_KEY_BITS]
            rest = np.setdiff1d(np.concatenate(bits[low:high]), key)
            blocks.append(Block(key, g, rest, tuple(bits[j] for j in range(low, high) if j != i), i - low))
    return Plan(tuple(blocks), groups, bits)


#: A member of a bucket, as it is packed.
_MEMBER = np.dtype([("node", "<i8"), ("fp", "<u8", (BITS // 64,))])


def _unpacked(fp: np.ndarray) -> np.ndarray:
    return np.unpackbits(np.ascontiguousarray(fp).view(np.uint8).reshape(len(fp), BITS // 8), axis=1)


def _number(bits: np.ndarray, places: np.ndarray) -> np.ndarray:
    return bits[:, places].astype(np.int64) @ (np.int64(1) << np.arange(len(places), dtype=np.int64))


def _collected(batches: Iterator[pa.RecordBatch], rows: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Nodes and fingerprints of batches, about ``rows`` at a time."""
    held: list[tuple[np.ndarray, np.ndarray]] = []
    for b in batches:
        if b.num_rows:
            raw = np.frombuffer(b"".join(b.column("fp").to_pylist()), dtype=np.uint64).reshape(-1, BITS // 64)
            held.append((b.column("node").to_numpy(), raw))
        if sum(len(n) for n, _ in held) >= rows:
            yield tuple(np.concatenate(x) for x in zip(*held))
            held = []
    if held:
        yield tuple(np.concatenate(x) for x in zip(*held))


def _keys(plan: Plan, bits: np.ndarray, block: int) -> np.ndarray:
    return (np.int64(block) << 48) | _number(bits, plan.blocks[block].key)


def _count_keys(plan: Plan):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, fp in _collected(batches, _PACK_ROWS):
            bits = _unpacked(fp)
            for i in range(len(plan.blocks)):
                key, n = np.unique(_keys(plan, bits, i), return_counts=True)
                yield pa.record_batch([pa.array(key), pa.array(n)], ["key", "n"])

    return run


def _block_rows(plan: Plan, hot: dict[int, int]):
    """Fingerprints -> (key, part, members): the members of a bucket that a batch has, packed.

    A bucket of ``hot`` has its rows dealt to as many hands as given there, and every two hands
    make a part: each pair of rows meets in some part.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for node, fp in _collected(batches, _PACK_ROWS):
            members = np.zeros(len(node), _MEMBER)
            members["node"], members["fp"] = node, fp
            bits = _unpacked(fp)
            for i in range(len(plan.blocks)):
                key = _keys(plan, bits, i)
                order = np.argsort(key, kind="stable")
                keys, first = np.unique(key[order], return_index=True)
                rows: list[tuple[int, int, bytes]] = []
                for k, cut in zip(keys.tolist(), np.split(members[order], first[1:])):
                    hands = hot.get(k, 1)
                    if hands == 1:
                        rows.append((k, 0, cut.tobytes()))
                        continue
                    hand = (mix64(cut["node"].astype(np.uint64)) % np.uint64(hands)).astype(np.int64)
                    for x in range(hands):
                        for y in range(x + 1, hands):
                            if len(some := cut[(hand == x) | (hand == y)]):
                                rows.append((k, x * hands + y, some.tobytes()))
                yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows), (pa.int64(), pa.int64(), pa.binary()))], ["key", "part", "members"])

    return run


def _apart(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return np.bitwise_count(x ^ y).sum(axis=-1, dtype=np.int64)


def _families(fp: np.ndarray, max_distance: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Labels of rows (0: none) such that rows with the same label are connected by the edges, also
    given, between positions. Leaders are rows spread over the bucket, as only families that hold
    a good part of it need to be told from the rest."""
    label = np.zeros(len(fp), dtype=np.int64)
    pivots = np.unique(np.linspace(0, len(fp) - 1, _LEADERS).astype(np.int64))
    hits = np.stack([_apart(fp, fp[p]) <= max_distance for p in pivots])
    some = hits.sum(axis=1) >= _FAMILY
    pivots, hits = pivots[some], hits[some]
    a, b = [], []
    todo, n = list(range(len(pivots))), 0
    while todo:
        n += 1
        queue, covered = [todo.pop(0)], np.zeros(len(fp), dtype=bool)
        while queue:
            k = queue.pop()
            new = np.flatnonzero(hits[k] & ~covered)
            common = np.flatnonzero(hits[k] & covered)[:1]
            at = np.concatenate([common, new])
            a.append(np.full(len(at), pivots[k]))
            b.append(at)
            covered |= hits[k]
            queue += (near := [j for j in todo if (hits[j] & covered).any()])
            todo = [j for j in todo if j not in near]
        label[covered] = n
    none = np.zeros(0, np.int64)
    return label, np.concatenate(a or [none]), np.concatenate(b or [none])


def _meeting(rest: np.ndarray, label: np.ndarray, slack: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Positions of the pairs whose words ``rest`` (rows, words) differ in at most ``slack`` bits
    and that don't share a label; rows come ordered by label."""
    n, columns = len(rest), [np.ascontiguousarray(w) for w in rest.T]
    end_of = np.searchsorted(label, label, side="right")
    across = min(n, _TILE_COLUMNS)
    down = _TILE // across
    x, counts = np.empty(down * across, rest.dtype), np.empty((2, down * across), np.uint8)
    for at in range(0, n - 1, down):
        upto = min(at + down, n)
        # rows of one label meet what comes behind it; others whatever comes behind themselves
        start = int(end_of[at]) if label[at] and end_of[at] >= upto else at + 1
        for c in range(start, n, across):
            d = min(c + across, n)
            shape = (upto - at, d - c)
            v, k, more = (y[: shape[0] * shape[1]].reshape(shape) for y in (x, *counts))
            for w, column in enumerate(columns):
                np.bitwise_xor(column[at:upto, None], column[c:d], out=v)
                np.bitwise_count(v, out=more if w else k)
                if w:
                    k += more
            hit = (k <= slack).ravel()
            if hit.any():
                i, j = np.divmod(np.flatnonzero(hit), shape[1])
                i, j = i + at, j + c
                ok = (i < j) & ((label[i] != label[j]) | (label[i] == 0))
                yield i[ok], j[ok]


def _gathered(pairs: Iterator[tuple[np.ndarray, np.ndarray]], least: int = 1 << 15) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The same pairs, ``least`` or more at a time, but for the last ones."""
    held, n = [], 0
    for pair in pairs:
        held.append(pair)
        n += len(pair[0])
        if n >= least:
            yield tuple(np.concatenate(x) for x in zip(*held))
            held, n = [], 0
    if n:
        yield tuple(np.concatenate(x) for x in zip(*held))


def _second_level(bits: np.ndarray, block: Block, base: int) -> Iterator[np.ndarray]:
    """Keys of rows in a large bucket, so that each pair within the group's slack that has no
    earlier equal block has an equal key: either a later block of the group is equal too, or no
    other block is, and then each of them differs in exactly one bit."""
    others = [b - base for b in block.others]
    for places in others[block.after :]:
        yield _number(bits, places[:_KEY_BITS])
    p, q = others[-1], others[-2] if len(others) > 1 else None
    for i in range(len(p)):
        key = _number(bits, np.delete(p, i)[:20])
        if q is None:
            yield key
            continue
        for j in range(len(q)):
            yield key << 20 | _number(bits, np.delete(q, j)[:20])


def _bucket_edges(plan: Plan, max_distance: int):
    """Rows (key, part, members) sorted by key and part -> edges (a, b), a < b; see the module."""

    def edges(key: int, members: np.ndarray) -> Iterator[pa.RecordBatch]:
        number = key >> 48
        block = plan.blocks[number]
        slack = plan.slack(block.group)
        node, fp = members["node"], np.ascontiguousarray(members["fp"])
        label = np.zeros(len(node), dtype=np.int64)
        if len(node) >= _LEADERS * 16:
            label, a, b = _families(fp, max_distance)
            if len(a):
                yield found(node[a], node[b])
                order = np.argsort(label, kind="stable")
                node, fp, label = node[order], fp[order], label[order]
        low, high = plan.groups[block.group]
        base, end = plan.bits[low][0] // 8, plan.bits[high - 1][-1] // 8 + 1
        bits = np.unpackbits(fp.view(np.uint8)[:, base:end], axis=1)  # of the group's bytes
        rest = np.pad(bits[:, block.rest - 8 * base], ((0, 0), (0, -len(block.rest) % 32)))
        rest = np.ascontiguousarray(np.packbits(rest, axis=1)).view(np.uint32)
        if len(node) <= _LARGE or not len(block.others):
            for i, j in _gathered(_meeting(rest, label, slack)):
                yield from verified(node, fp, number, i, j)
            return
        for other in _second_level(bits, block, 8 * base):
            order = np.argsort(other, kind="stable")  # by label within a key
            cuts = np.flatnonzero(np.diff(other[order])) + 1
            met = ((some[i], some[j]) for some in np.split(order, cuts) if len(some) > 1 for i, j in _meeting(rest[some], label[some], slack))
            for i, j in _gathered(met):
                yield from verified(node, fp, number, i, j)

    def verified(node: np.ndarray, fp: np.ndarray, number: int, i: np.ndarray, j: np.ndarray) -> Iterator[pa.RecordBatch]:
        """Those within the distance whose first group within its slack, and first equal block of it, is this one."""
        x = fp[i] ^ fp[j]
        near = np.flatnonzero(np.bitwise_count(x).sum(axis=1) <= max_distance)
        if not len(near):
            return
        differ = np.add.reduceat(_unpacked(x[near]), [b[0] for b in plan.bits], axis=1, dtype=np.int16)
        group = np.add.reduceat(differ, [low for low, _ in plan.groups], axis=1)
        first = (group <= [plan.slack(g) for g in range(len(plan.groups))]).argmax(axis=1)
        low, high = plan.groups[plan.blocks[number].group]
        near = near[(first == plan.blocks[number].group) & (low + (differ[:, low:high] == 0).argmax(axis=1) == number)]
        if len(near):
            yield found(node[i[near]], node[j[near]])

    def found(a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
        a, b = np.minimum(a, b), np.maximum(a, b)
        return pa.record_batch([pa.array(a[a != b]), pa.array(b[a != b])], ["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held = None, []
        for batch in batches:
            for key, part, members in zip(batch.column("key").to_pylist(), batch.column("part").to_pylist(), batch.column("members")):
                if (key, part) != at:
                    if held:
                        yield from edges(at[0], np.concatenate(held))
                    at, held = (key, part), []
                held.append(np.frombuffer(members.as_py(), _MEMBER))
        if held:
            yield from edges(at[0], np.concatenate(held))

    return run


def near_pairs(nodes: DataFrame, max_distance: int = MAX_DISTANCE, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """Edges (a, b), a < b, between nodes (node bigint, fp binary; both unique) that connect what
    all pairs at most ``max_distance`` apart connect, and nothing else."""
    plan, some = plan_blocks(max_distance), nodes.select("node", "fp")
    sizes = some.mapInArrow(_count_keys(plan), "key long, n long").groupBy("key").agg(F.sum("n").alias("n"))
    # at most (distance + 1) * nodes / bucket_rows keys
    hot = {r.key: -(-2 * r.n // bucket_rows) for r in sizes.where(F.col("n") > bucket_rows).collect()}
    rows = some.mapInArrow(_block_rows(plan, hot), "key long, part long, members binary")
    met = rows.repartition("key", "part").sortWithinPartitions("key", "part")
    return met.mapInArrow(_bucket_edges(plan, max_distance), "a long, b long").distinct()


def components(edges: DataFrame, folder: str) -> DataFrame:
    """(node, root) of every node on an edge (a, b) but the roots, the smallest nodes of their components.

    Alternating large-star and small-star steps, each a shuffle of the edges, until nothing
    changes; the steps are written to the shared folder, not kept in lineage.
    """
    step, before = 0, None
    edges = settle(edges.select("a", "b"), f"{folder}/{step}")
    while True:
        both = edges.union(edges.select(F.col("b"), F.col("a"))).toDF("u", "v")
        low = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
        large = both.join(low, "u").where(F.col("v") > F.col("u")).select(F.col("m").alias("a"), F.col("v").alias("b")).where("a <> b").distinct()
        step += 1
        large = settle(large, f"{folder}/{step}")
        down = large.select(F.col("b").alias("u"), F.col("a").alias("v"))
        low = down.groupBy("u").agg(F.min("v").alias("m"))
        small = down.join(low, "u").select(F.col("m").alias("a"), F.explode(F.array("u", "v")).alias("b")).where("a <> b").distinct()
        step += 1
        edges = settle(small, f"{folder}/{step}")
        now = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == before:
            return edges.groupBy(F.col("b").alias("node")).agg(F.min("a").alias("root")).select("node", "root")
        before = now


def _groups(rows: DataFrame, folder: str, max_distance: int) -> DataFrame:
    """rows (rid bigint unique, doc_id, fp binary) -> (rid, doc_id, kept, kept_rid) of all rows that go."""
    rank = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "rid")
    some = rows.where(F.col("fp").isNotNull())
    nodes = settle(some.groupBy("fp").agg(F.min("rid").alias("node")), f"{folder}/nodes")
    roots = settle(components(near_pairs(nodes, max_distance), f"{folder}/steps"), f"{folder}/roots")
    # a fingerprint's rows follow its node's root; nodes without a partner are their own
    group = nodes.join(roots, "node", "left").select("fp", F.coalesce("root", "node").alias("root"))
    placed = settle(some.select("rid", "doc_id", "fp").join(group, "fp").select("rid", "doc_id", "root"), f"{folder}/placed")
    best = placed.groupBy("root").agg(F.min(rank).alias("best"), F.count(F.lit(1)).alias("n")).where("n > 1")
    return (
        placed.join(best.select("root", F.col("best.doc_id").alias("kept"), F.col("best.rid").alias("kept_rid")), "root")
        .where(F.col("rid") != F.col("kept_rid")).select("rid", "doc_id", "kept", "kept_rid")
    )


def near_duplicates(docs: DataFrame, id_column: str = "doc_id", text: str = "text", max_distance: int = MAX_DISTANCE) -> DataFrame:
    """(doc_id, near_duplicate_of) of every row that goes, with the id of the one that stays; see the module."""
    folder = shared_dir(docs.sparkSession, "simhash")
    rows = docs.select(F.col(id_column).alias("doc_id"), fingerprint(F.col(text)).alias("fp")).withColumn("rid", F.monotonically_increasing_id())
    rows = settle(rows, f"{folder}/fingerprints")
    return _groups(rows, folder, max_distance).select("doc_id", F.col("kept").alias("near_duplicate_of"))


def drop_near_duplicates(docs: DataFrame, id_column: str = "doc_id", text: str = "text", max_distance: int = MAX_DISTANCE) -> DataFrame:
    """``docs`` with one row of each group.

    Rows get numbers and fingerprints once, in a copy on the shared folder; the numbers of
    those that go are a sorted table there, which each task of the final scan looks up for
    its own rows. No text is shuffled.
    """
    spark, folder = docs.sparkSession, shared_dir(docs.sparkSession, "simhash")
    rid, fp = fresh(docs, "rid"), fresh(docs, "fp")
    marked = settle(docs.withColumn(fp, fingerprint(F.col(text))).withColumn(rid, F.monotonically_increasing_id()), f"{folder}/marked")
    rows = marked.select(F.col(rid).alias("rid"), F.col(id_column).alias("doc_id"), F.col(fp).alias("fp"))
    gone = f"{folder}/gone"
    SortedTable.write(_groups(rows, folder, max_distance).select(F.col("rid").alias("key")), gone, int(spark.conf.get("spark.sql.shuffle.partitions")))
    return marked.where(~_listed(gone)(F.col(rid))).select(*[F.col(f"`{c}`") for c in docs.columns])


def _listed(uri: str):
    @F.arrow_udf(T.BooleanType())
    def listed(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        table = SortedTable(uri)
        for key in batches:
            keys = key.to_numpy(zero_copy_only=False)
            order = np.argsort(keys, kind="stable")
            found = np.zeros(len(keys), dtype=bool)
            found[order] = table.lookup(keys[order])[0]
            yield pa.array(found)

    return listed
