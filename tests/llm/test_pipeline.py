"""The pipeline, stage by stage, against brute force over what the stage before kept."""

from __future__ import annotations

from tests.llm.test_dedup import brute_exact, brute_near
from tests.llm.test_tokens import _library

import corpus_pipeline
from vectorframe.llm import mixing, quality


def test_stages(spark, sf_dir, docs):
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality classifier", "exact dedup", "SimHash near-dedup", "mixing to target weights", "BPE encoding"]
    kept, now = [], docs
    for n, (_, stage) in enumerate(corpus_pipeline.STAGES):
        now = stage(spark, now, sf_dir)
        if n < 4:
            assert now.columns == docs.columns
        now = now.cache()
        kept.append(now)
    rows = [[tuple(r) for r in k.select("doc_id", "text").collect()] for k in kept[:4]]
    source = [tuple(r) for r in docs.select("doc_id", "text").collect()]
    good = {r.doc_id for r in quality.classify(docs, quality.train(docs, labels)).where("accepted").collect()}
    assert sorted(rows[0]) == sorted(r for r in source if r[0] in good) and len(rows[0]) < len(source)
    truth = {r.doc_id: r.quality for r in labels.collect()}
    assert sum(i in good for i, q in truth.items() if q) >= 0.97 * sum(1 for q in truth.values() if q)
    gone = [i for i, _ in brute_exact(rows[0])]
    assert sorted(i for i, _ in rows[1]) == sorted({i for i, _ in rows[0]} - set(gone))
    root = brute_near(rows[1])
    groups = {}
    for i, r in root.items():
        groups.setdefault(r, []).append(rows[1][i][0])
    assert sorted(i for i, _ in rows[2]) == sorted(min(g) for g in groups.values())
    assert {i for i, _ in rows[3]} == {r.doc_id for r in mixing.mix(kept[2]).collect()}
    last = {r.doc_id: r for r in kept[4].collect()}
    assert set(last) == {i for i, _ in rows[3]} and all(r.round_trip for r in last.values())
    assert all(last[i].tokens == _library().encode_ordinary(t) for i, t in rows[3])
    whole = corpus_pipeline.run(spark, sf_dir)
    assert {(r.doc_id, r.n_tokens) for r in whole.select("doc_id", "n_tokens").collect()} == {(r.doc_id, r.n_tokens) for r in last.values()}
