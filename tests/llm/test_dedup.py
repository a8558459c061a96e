"""Exact and near duplicates against brute force."""

from __future__ import annotations

from collections import defaultdict

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from vectorframe.llm import exact_dedup, quality, queries, simhash
from vectorframe.llm.shared import SortedTable, shared_dir


def test_extendible_hash():
    rng = np.random.default_rng(1)
    for skip in (0, 3):
        keys = rng.integers(0, 2**63, 5000).astype(np.uint64)
        keys = np.concatenate([keys, np.arange(40, dtype=np.uint64), keys[:300]])  # near zero: the directory must go deep
        if skip:
            keys &= np.uint64((1 << 61) - 1)
        table, want = exact_dedup.ExtendibleHash(skip, 16), defaultdict(int)
        for part in np.array_split(keys, 7):
            table.insert(part, np.ones(len(part), np.int64))
        for k in keys.tolist():
            want[k] += 1
        assert {k: n for ks, ns in zip(table.keys, table.counts) for k, n in zip(ks.tolist(), ns.tolist())} == want
        assert table.depth <= exact_dedup.MAX_DEPTH and sum(len(k) > 16 for k in table.keys) <= 1  # the crowd near zero
        pages = exact_dedup.Pages(table.chained().dump())
        probe = np.concatenate([np.unique(keys), rng.integers(0, 2**61, 500).astype(np.uint64)])
        assert pages.contains(probe).tolist() == [want.get(k, 0) > 1 for k in probe.tolist()]
    assert not exact_dedup.Pages(exact_dedup.ExtendibleHash(2).dump()).contains(np.arange(5, dtype=np.uint64)).any()


def brute_exact(rows):
    """Rows (id, text) -> sorted pairs that go."""
    groups = defaultdict(list)
    for i, t in rows:
        if t is not None:
            groups[t].append(i)
    out = []
    for ids in groups.values():
        ids = sorted(ids, key=lambda i: (i is None, i or 0))
        out += [(i, ids[0]) for i in ids[1:]]
    return sorted(out, key=str)


def test_exact_odd_rows(odd, nothing):
    rows = [(r.doc_id, r.text) for r in odd.select("doc_id", "text").collect()]
    assert sorted(map(tuple, exact_dedup.exact_duplicates(odd).collect()), key=str) == brute_exact(rows)
    kept = exact_dedup.drop_exact_duplicates(odd)
    assert kept.columns == odd.columns
    left = [(r.doc_id, r.text) for r in kept.select("doc_id", "text").collect()]
    assert len(left) == len(rows) - len(brute_exact(rows)) and brute_exact(left) == [] and {t for _, t in left} == {t for _, t in rows}
    assert (1, rows[[t for _, t in rows].index("the same text stands here in full")][1]) in left and (5, "") in left
    assert exact_dedup.exact_duplicates(nothing).count() == 0 and exact_dedup.drop_exact_duplicates(nothing).count() == 0


def test_exact_when_all_keys_collide(odd, monkeypatch):
    monkeypatch.setattr(exact_dedup, "text_key", lambda text: F.when(text.isNotNull(), F.lit(12345).cast("long")))
    rows = [(r.doc_id, r.text) for r in odd.select("doc_id", "text").collect()]
    got = exact_dedup.exact_duplicates(odd).collect()
    want = brute_exact(rows)
    assert len(got) == len(want) and {(r.doc_id, r.duplicate_of) for r in got} == set(want)


def test_exact_against_sql(spark, sf_dir):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{sf_dir}/documents.parquet'")
    want = sorted(con.sql(queries.SQL["op7_exact_dedup"]).fetchall())
    assert sorted(map(tuple, queries.QUERIES["op7_exact_dedup"](spark, sf_dir).collect())) == want


def test_sorted_table(spark):
    uri = f"{shared_dir(spark, 'sorted')}"
    SortedTable.write(spark.range(0, 3000, 3).select(F.col("id").alias("key"), (F.col("id") * 0.5).alias("x")), uri, 5)
    table = SortedTable(uri, cache_bytes=4000)  # fewer than all shards fit
    there, (x,) = table.lookup(np.arange(-5, 3010))
    keys = np.arange(-5, 3010)
    want = (keys >= 0) & (keys < 3000) & (keys % 3 == 0)
    assert (there == want).all() and (x[want] == keys[want] * 0.5).all() and np.isnan(x[~want]).all() and len(table.cache) < 5


# ---------------------------------------------------------------- near duplicates


def brute_near(rows, distance=simhash.MAX_DISTANCE):
    """Rows (id, text) -> root row of each row with words, by all pairs, and the number of pairs."""
    bits, some = simhash.fingerprints(pa.array([t for _, t in rows], pa.string()))
    at = np.flatnonzero(some)
    root = {int(i): int(i) for i in at}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for n, i in enumerate(at):
        d = np.bitwise_count(bits[i] ^ bits[at[n + 1 :]]).sum(axis=1)
        for j in at[n + 1 :][d <= distance]:
            a, b = find(int(i)), find(int(j))
            root[max(a, b)] = min(a, b)
    return {i: find(i) for i in root}


def test_near_against_brute_force(spark, docs, texts):
    words = [t.split() for t in texts.values() if len(t.split()) > 60][:40]
    rng = np.random.default_rng(2)
    edited = []
    for n, w in enumerate(words):
        w = list(w)
        for _ in range(len(w) // 25):
            w[rng.integers(len(w))] = f"word{rng.integers(999)}"
        edited.append((1_000_000 + n, " ".join(w)))
    rows = [*texts.items(), *edited]
    table = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    root = brute_near(rows)
    gone = {(rows[i][0], rows[r][0]) for i, r in root.items() if i != r}
    size = defaultdict(set)
    for i, r in root.items():
        size[r].add(rows[i][0])
    got = simhash.near_duplicates(table).collect()
    first = {r: min(ids) for r, ids in size.items()}
    assert {(g.doc_id, g.near_duplicate_of) for g in got} == {(rows[i][0], first[r]) for i, r in root.items() if rows[i][0] != first[r]}
    assert len(got) == len(gone) and sum(g.doc_id >= 1_000_000 for g in got) >= 0.9 * len(edited)


def test_the_same_pairs_at_every_size(spark):
    """A table alone, and among a hundred times as many other fingerprints."""
    rng = np.random.default_rng(11)
    fp = rng.integers(0, 2**63, (300, 4)).astype(np.uint64)
    for i in range(1, 300, 2):
        fp[i] = flipped(fp[i - 1], rng.permutation(simhash.BITS)[: 1 + i % simhash.MAX_DISTANCE])
    more = rng.integers(0, 2**63, (30_000, 4)).astype(np.uint64)
    nodes = [(i, bytearray(x.tobytes())) for i, x in enumerate(np.concatenate([fp, more]))]
    alone, among = (spark.createDataFrame(nodes[:n], "node long, fp binary").repartition(3) for n in (300, len(nodes)))
    want = {(i - 1, i) for i in range(1, 300, 2)}
    assert {tuple(r) for r in simhash.near_pairs(alone).collect()} == want
    assert {tuple(r) for r in simhash.near_pairs(among).collect()} == want
    assert {tuple(r) for r in simhash.near_pairs(alone, bucket_rows=3).collect()} == want  # all but the smallest buckets dealt to hands


def test_ids_of_other_types(spark):
    text = "one text of several words that stands here more than once"
    rows = [("b", text), ("a", text), (None, text), ("c", text + " again"), ("d", "wholly other words are in this one")]
    df = spark.createDataFrame(rows, "name string, text string")
    assert {tuple(r) for r in simhash.near_duplicates(df, "name").collect()} >= {("b", "a"), (None, "a")}
    assert {tuple(r) for r in exact_dedup.exact_duplicates(df, "name").collect()} == {("b", "a"), (None, "a")}
    assert sorted(r.name for r in exact_dedup.drop_exact_duplicates(df, "name").collect()) == ["a", "c", "d"]


def test_near_odd_rows(odd, nothing):
    rows = [(r.doc_id, r.text) for r in odd.select("doc_id", "text").collect()]
    kept = simhash.drop_near_duplicates(odd)
    assert kept.columns == odd.columns
    left = sorted(((r.doc_id, r.text) for r in kept.select("doc_id", "text").collect()), key=str)
    texts = [t for _, t in left]
    assert texts.count(None) == 3 and texts.count("") == 2 and "   \n\t " in texts and "!!! ... ---" in texts  # no words: they stay
    assert [i for i, t in left if t and t.startswith("the same")] == [1]
    assert [i for i, t in left if t and len(t) > 100_000] == [8]  # two copies and a near one
    gone = sorted(((r.doc_id, r.near_duplicate_of) for r in simhash.near_duplicates(odd).collect()), key=str)
    assert gone == sorted([(2, 1), (2, 1), (None, 1), (9, 8), (10, 8)], key=str) and len(rows) == len(left) + len(gone)
    assert simhash.near_duplicates(nothing).count() == 0 and simhash.drop_near_duplicates(nothing).count() == 0


def test_components(spark):
    rng = np.random.default_rng(5)
    pairs = {tuple(sorted(map(int, p))) for p in rng.integers(0, 400, (260, 2)) if p[0] != p[1]} | {(i, i + 1) for i in range(1000, 1060)}
    root: dict[int, int] = {}

    def find(i):
        root.setdefault(i, i)
        while root[i] != i:
            i = root[i]
        return i

    for a, b in pairs:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    got = simhash.components(spark.createDataFrame(sorted(pairs), "a long, b long"), shared_dir(spark, "components"))
    assert {(r.node, r.root) for r in got.collect()} == {(i, find(i)) for i in root if i != find(i)}


def flipped(fp, places):
    bits = np.unpackbits(fp.view(np.uint8))
    bits[places] ^= 1
    return np.packbits(bits).view(np.uint64)


def test_fingerprints_do_not_depend_on_neighbours():
    """One-letter words in rows whose numbers are those letters' codes."""
    letters = "abcdefghijklmnopqrstuvwxyz0123456789"
    texts = [" ".join((letters[i % 36 :] + letters)[:20] * 2) for i in range(260)]
    together, alone = simhash.fingerprints(pa.array(texts))[0], np.concatenate([simhash.fingerprints(pa.array([t]))[0] for t in texts])
    assert (together == alone).all()
    np.testing.assert_array_equal(quality.statistics(pa.array(texts)), np.concatenate([quality.statistics(pa.array([t])) for t in texts]))


@pytest.mark.parametrize("distance", [0, 1, 7, 41, 48, 255])
def test_close_pairs_share_a_block(distance):
    plan = simhash.plan_blocks(distance)
    assert np.array_equal(np.concatenate(plan.bits), np.arange(simhash.BITS)) and len(plan.blocks) == distance + 1
    rng = np.random.default_rng(distance)
    differ = np.zeros((500, simhash.BITS), dtype=bool)
    np.put_along_axis(differ, rng.permuted(np.tile(np.arange(simhash.BITS), (500, 1)), axis=1)[:, :distance], True, axis=1)
    for row in differ:
        near = [g for g, (low, high) in enumerate(plan.groups) if row[np.concatenate(plan.bits[low:high])].sum() <= plan.slack(g)]
        assert near and all(any(not row[plan.bits[i]].any() for i in range(*plan.groups[g])) for g in near)


def edges_of(fp, distance, hot=None):
    plan = simhash.plan_blocks(distance)
    order = np.random.default_rng(0).permutation(len(fp))
    nodes = pa.record_batch([pa.array(order), pa.array([x.tobytes() for x in fp[order]], pa.binary())], ["node", "fp"])
    rows = pa.Table.from_batches(simhash._block_rows(plan, hot or {})(iter([nodes]))).sort_by([("key", "ascending"), ("part", "ascending")])
    return [(a, b) for out in simhash._bucket_edges(plan, distance)(iter(rows.to_batches())) for a, b in zip(out["a"].to_pylist(), out["b"].to_pylist())]


@pytest.mark.parametrize(("n", "distance", "large"), [(30, 41, 1 << 16), (300, 41, 1 << 16), (300, 41, 8), (2500, 41, 1 << 16), (300, 48, 8), (300, 3, 8), (60, 0, 8)])
def test_bucket_edges_connect_all_near_rows(n, distance, large, monkeypatch):
    monkeypatch.setattr(simhash, "_LARGE", large)
    rng = np.random.default_rng(n)
    fp = rng.integers(0, 2**63, (n, 4)).astype(np.uint64)
    for i in range(1, n // 3):  # families by chains
        if i % 5:
            fp[i] = flipped(fp[i - 1], rng.permutation(simhash.BITS)[: max(1, distance - 2)])
    check(fp, edges_of(fp, distance), distance)


def test_a_large_family(monkeypatch):
    """A third of all rows near one another: few edges leave the buckets, and none is lost."""
    monkeypatch.setattr(simhash, "_LEADERS", 16)
    monkeypatch.setattr(simhash, "_FAMILY", 8)
    rng = np.random.default_rng(4)
    fp = rng.integers(0, 2**63, (1500, 4)).astype(np.uint64)
    fp[:, 0] &= np.uint64(0xFFFFFFFFFFFF0000)  # all meet in some buckets
    for i in range(1, 500):
        fp[i] = flipped(fp[0], rng.permutation(simhash.BITS)[: 5 + i % 20])
    fp[900] = flipped(fp[7], rng.permutation(simhash.BITS)[:38])
    pairs = edges_of(fp, 41)
    check(fp, pairs, 41)
    assert len(set(pairs)) < 42 * 500 * 3 < 500 * 499 / 2


def check(fp, pairs, distance):
    n = len(fp)
    near = {(i, j) for i in range(n) for j in (np.flatnonzero(np.bitwise_count(fp[i] ^ fp[i + 1 :]).sum(axis=1) <= distance) + i + 1).tolist()}
    assert set(pairs) <= near

    def groups(edges):
        root = list(range(n))

        def find(i):
            while root[i] != i:
                i = root[i]
            return i

        for a, b in edges:
            a, b = find(a), find(b)
            root[max(a, b)] = min(a, b)
        return [find(i) for i in range(n)]

    assert groups(pairs) == groups(near)
