"""Quality classifier, language identification, mixing and LM scoring against brute force and held-out rows."""

from __future__ import annotations

import math
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from vectorframe.llm import langid, lm, mixing, quality

# ---------------------------------------------------------------- quality


def test_density_by_hand():
    rng = np.random.default_rng(1)
    x, good = rng.normal(size=(300, 5)) * [1, 2, 3, 4, 0.1], rng.random(300) < 0.7
    x[good] += 1
    m = quality.fit(x, good, 0.3, 0.2)
    scale = x.std(axis=0) + 1e-6
    want = np.zeros(300)
    c = {k: np.cov((x[good == k] / scale).T) for k in (False, True)}
    n = {k: int((good == k).sum()) for k in (False, True)}
    pooled = (c[False] * (n[False] - 1) + c[True] * (n[True] - 1)) / 298
    for k, sign in ((True, 1), (False, -1)):
        s = 0.7 * c[k] + 0.3 * pooled
        s = 0.8 * s + 0.2 * (np.trace(s) / 5 + 1e-9) * np.eye(5)
        z = (x - x[good == k].mean(axis=0)) / scale
        want += sign * (math.log(n[k] / 300) - 0.5 * np.linalg.slogdet(s)[1] - 0.5 * np.einsum("ij,jk,ik->i", z, np.linalg.inv(s), z))
    np.testing.assert_allclose(m.score(x), want, atol=1e-8)


def test_statistics_of_a_text():
    x = dict(zip(quality.STATISTICS, quality.statistics(pa.array(["Aa aa aa. 12\nAa aa aa. 12\n"]))[0]))
    size = 26
    assert x["log_bytes"] == pytest.approx(math.log1p(size)) and x["digits"] == pytest.approx(math.log(4.5 / (size - 4 + 0.5)))
    assert x["log_distinct"] == pytest.approx(math.log(5 / 9)) and x["duplicate_lines"] == pytest.approx(math.log(12.5 / (size - 12 + 0.5)))
    apart = quality.statistics(pa.array(["x y", None, "", " ", "x y"]))
    assert np.isnan(apart[1:4]).all() and (apart[0] == apart[4]).all()


def test_held_out(spark):
    folder = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{folder}/documents.parquet"), spark.read.parquet(f"{folder}/labels.parquet")
    half = F.xxhash64("doc_id") > 0
    model = quality.train(docs, labels.where(half))
    rows = quality.classify(docs, model).join(labels.where(~half), "doc_id").collect()
    kept = [r.accepted for r in rows if r.quality]
    bad = [r.accepted for r in rows if not r.quality]
    assert len(bad) > 10 and np.mean(kept) > 0.97 and np.mean(bad) < 0.1


def test_quality_odd_rows(spark, odd, nothing, docs, sf_dir):
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = quality.train(docs, labels.unionByName(spark.createDataFrame([(None, 1, 0), (1, None, None)], labels.schema)))
    rows = quality.classify(odd, model).collect()
    blank = {3, 4, 5, 6, 7}
    assert len(rows) == odd.count() and all((r.score is None) == (not r.accepted and r.score is None) for r in rows)
    assert all(r.score is None and not r.accepted for r in rows if r.doc_id in blank)
    assert all(r.score is not None for r in rows if r.doc_id in {1, 8, 11, 13, 14})
    kept = quality.accepted(odd, model)
    assert kept.columns == odd.columns and kept.count() == sum(r.accepted for r in rows)
    none = quality.train(docs, labels.where("quality = 1"))  # one class: no model
    assert none is None and quality.accepted(odd, none).count() == odd.where("text rlike '\\\\S'").count()
    assert quality.classify(nothing, model).count() == 0 and quality.train(nothing, labels) is None


# ---------------------------------------------------------------- languages


def test_viterbi_by_hand():
    rng = np.random.default_rng(4)
    lengths = np.array([1, 2, 130, 64, 65, 7, 300])
    scores = rng.normal(size=(lengths.sum(), 3)) * 3
    got = langid.viterbi(scores, lengths, 4.0, block=16)
    at = 0
    for n in lengths:
        s, best, back = scores[at : at + n], scores[at].copy(), []
        for i in range(1, n):
            step = best[:, None] - 4.0 * (1 - np.eye(3))
            back.append(step.argmax(axis=0))
            best = step.max(axis=0) + s[i]
        path = got[at : at + n]
        value = s[np.arange(n), path].sum() - 4.0 * (np.diff(path) != 0).sum()
        assert value == pytest.approx(best.max())
        at += n


@pytest.fixture(scope="module")
def languages(docs):
    return langid.train(docs.where(F.xxhash64("doc_id") > 0))


def test_held_out_languages(docs, languages):
    rows = langid.identify(docs, languages).join(docs.select("doc_id", F.col("lang").alias("told")), "doc_id").where(F.xxhash64("doc_id") <= 0).collect()
    assert len(rows) > 50 and np.mean([r.lang == r.told for r in rows]) > 0.95


def test_mixed_text(spark, docs, languages):
    one = {r.lang: " ".join(r.text.split()[:60]) for r in docs.where("lang in ('en', 'de') and n_chars > 600").collect()}
    text = f"{one['en']} {one['de']} это русский язык и еще слова"
    r = langid.identify(spark.createDataFrame([(1, text)], "doc_id long, text string"), languages).first()
    spans = [(s.lang, s.start, s.end) for s in r.spans]
    assert spans[-1][0] == "script:cyrillic" and {"en", "de"} <= {s[0] for s in spans} and len(spans) <= 6
    raw = text.encode()
    assert raw[spans[-1][1] : spans[-1][2]].decode().strip() == "это русский язык и еще слова"
    # lower-casing changes how many bytes letters have: places are those of the given text
    given = f"\u2c6f\u2c62\u1e9e {text}"
    r = langid.identify(spark.createDataFrame([(0, "x"), (1, given)], "doc_id long, text string").repartition(1), languages).where("doc_id = 1").first()
    assert given.encode()[r.spans[-1].start : r.spans[-1].end].decode() == "это русский язык и еще слова"


def test_viterbi_of_many_labels():
    scores = np.zeros((3, 200))
    scores[:, 150] = 1.0
    assert langid.viterbi(scores, np.array([3])).tolist() == [150, 150, 150]


def test_language_odd_rows(odd, nothing, languages):
    rows = {(r.doc_id, i): r for i, r in enumerate(langid.identify(odd, languages).collect())}
    assert len(rows) == odd.count()
    for (i, _), r in rows.items():
        if i in (3, 4, 5, 6, 7, 11, 15):
            assert r.lang is None and r.share is None and r.spans == []
        elif i is not None:
            assert r.lang and 0 < r.share <= 1 and r.spans
    assert langid.identify(nothing, languages).count() == 0
    empty = langid.train(nothing)
    assert {r.lang for r in langid.identify(odd.where("doc_id = 1"), empty).collect()} == {"script:latin"}


# ---------------------------------------------------------------- mixing


def test_rake_against_marginals():
    rng = np.random.default_rng(6)
    codes = [rng.integers(0, k, 60) for k in (4, 3, 2)]
    mass = rng.random(60)
    targets = [np.array(t) for t in ([0.1, 0.2, 0.3, 0.4], [0.5, 0.25, 0.25], [0.7, 0.3])]
    out, worst = mixing.rake(mass / mass.sum(), codes, targets)
    assert worst <= mixing.TOLERANCE
    for c, t in zip(codes, targets):
        np.testing.assert_allclose(np.bincount(c, weights=out), t, atol=1e-8)


def test_probabilities_reach_the_targets(spark, docs):
    targets = {"lang": {"en": 0.4, "de": 0.3, "fr": 0.2, "es": 0.1}}
    measured, names, words = mixing._measured(docs, "text", [F.col("source"), F.col("lang")], None, None)
    cells = measured.groupBy(*names).agg(F.sum(words).alias("tokens")).toDF("source", "lang", "topic", "tokens").cache()
    here = {(r.source, r.lang, r.topic): r for r in mixing.cell_probabilities(cells, targets).collect()}
    mass, total = Counter(), 0.0
    for (_, lang, _), r in here.items():
        assert 0 <= r.probability <= 1
        mass[lang] += r.tokens * r.probability
        total += r.tokens * r.probability
    for lang, share in targets["lang"].items():
        assert mass[lang] / total == pytest.approx(share, abs=1e-3)
    assert max(r.probability for r in here.values()) == pytest.approx(1)


def test_raking_as_a_table_gives_the_same(spark):
    rows = [("a", "en", "t", 30), ("a", "de", "t", 30), (None, "en", "t", 20), (None, "de", "t", 20), ("b", "de", "t", 0)]  # independent: two rounds do
    cells = spark.createDataFrame(rows, "source string, lang string, topic string, tokens long")
    one, two = ({(r.source, r.lang, r.topic): (round(r.wanted, 7), round(r.probability, 6)) for r in mixing.cell_probabilities(cells, {"lang": {"en": 0.7, "de": 0.3}}, driver_cells=n).collect()} for n in (100, 0))
    assert one == two and len(one) == 5


def test_a_table_that_takes_many_rounds(spark):
    rng = np.random.default_rng(3)
    rows = [(s, x, t, int(rng.integers(1, 900) * (1 + (s == x)) ** 3)) for s in "abc" for x in "abc" for t in "tu"]
    cells = spark.createDataFrame(rows, "source string, lang string, topic string, tokens long")
    targets = {"lang": {"a": 0.5, "b": 0.3, "c": 0.2}, "source": {"a": 0.2, "b": 0.2, "c": 0.6}}
    one, two = ({(r.source, r.lang, r.topic): (r.wanted, r.probability) for r in mixing.cell_probabilities(cells, targets, driver_cells=n).collect()} for n in (100, 0))
    assert all(np.allclose(one[k], two[k], atol=1e-7) for k in one) and len(one) == 18


def test_contradictory_targets_are_told(spark):
    cells = spark.createDataFrame([("a", "x", "t", 50), ("b", "y", "t", 50)], "source string, lang string, topic string, tokens long")
    targets = {"source": {"a": 0.8, "b": 0.2}, "lang": {"x": 0.2, "y": 0.8}}
    for n in (100, 0):
        with pytest.warns(UserWarning, match="marginals differ"):
            rows = mixing.cell_probabilities(cells, targets, driver_cells=n, rounds=5).collect()
        assert all(r.marginal_error == pytest.approx(0.6) for r in rows)


def test_many_categories_and_own_counts(spark):
    cells = spark.range(20_000).selectExpr("cast(id as string) source", "'en' lang", "'t' topic", "id + 1 tokens")
    assert mixing.cell_probabilities(cells).count() == 20_000
    df = spark.range(40).selectExpr("id doc_id", "'same text' text", "'s' source", "'en' lang", "id n", "id % 2 kind")
    got = mixing.mix(df, {"topic": {"0": 0.5, "1": 0.5}}, topic=F.col("kind"), counts=F.col("n")).collect()
    assert got and all(r.tokens == r.doc_id for r in got) and {round(r.probability, 3) for r in got} == {1.0, 0.95} - ({0.95} if all(r.doc_id % 2 == 0 for r in got) else set())


def test_sampling(spark, docs):
    got = mixing.mix(docs).collect()
    p = {r.doc_id: r.probability for r in got}
    assert 0 < len(got) < docs.count() and {r.doc_id for r in mixing.mix(docs.repartition(7)).collect()} == set(p)
    kept = mixing.sample(docs)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == set(p)
    many = spark.range(4000).select(F.col("id").alias("doc_id"), F.lit("three words here").alias("text"), F.when(F.col("id") < 3000, "x").otherwise("y").alias("source"), F.lit("en").alias("lang"))
    by = Counter(r.source for r in mixing.sample(many, {"source": {"x": 0.5, "y": 0.5}}).collect())
    assert by["y"] == 1000 and abs(by["x"] - 1000) < 110


def test_mixing_odd_rows(odd, nothing):
    kept = mixing.sample(odd)
    assert kept.columns == odd.columns and kept.count() <= odd.count()
    assert {(r.doc_id, r.text) for r in kept.select("doc_id", "text").collect()} <= {(r.doc_id, r.text) for r in odd.select("doc_id", "text").collect()}
    assert mixing.mix(nothing).count() == 0 and mixing.sample(nothing).count() == 0
    assert mixing.sample(odd.where("text is null")).count() == 0  # no tokens at all
    assert mixing.sample(odd, {"lang": {"xx": 1.0}}).count() == 0  # targets without documents


# ---------------------------------------------------------------- context trees


def brute_ctw(corpus, scored, depth):
    """Bits of texts under trees built node by node."""
    counts = defaultdict(lambda: [0, 0])

    def decisions(text):
        data = text.encode()
        for n, byte in enumerate(data):
            context = [data[n - k] if n - k >= 0 else 0 for k in range(1, depth + 1)]
            node = 1
            for i in range(7, -1, -1):
                bit = byte >> i & 1
                yield context, node, bit
                node = node * 2 + bit

    for text in corpus:
        for context, node, bit in decisions(text):
            for d in range(depth + 1):
                counts[(node, *context[:d])][bit] += 1
    children = defaultdict(list)
    for key in counts:
        if len(key) > 1:
            children[key[:-1]].append(key)
    weights = {}

    def log_weighted(key):
        a, b = counts[key]
        kt = math.lgamma(a + 0.5) + math.lgamma(b + 0.5) - math.log(math.pi) - math.lgamma(a + b + 1)
        if len(key) == depth + 1:
            weights[key] = 1.0
            return kt
        below = sum(log_weighted(c) for c in children[key])
        both = np.logaddexp(kt, below)
        weights[key] = math.exp(kt - both)
        return both - math.log(2)

    for node in {k[0] for k in list(counts)}:
        log_weighted((node,))

    def probability(context, node):
        p = 0.5
        for d in range(depth, -1, -1):
            key = (node, *context[:d])
            if key in weights:
                a, b = counts[key]
                p = weights[key] * (b + 0.5) / (a + b + 1) + (1 - weights[key]) * p
            else:
                p = 0.5
        return p

    return [sum(-math.log2(p if bit else 1 - p) for context, node, bit in decisions(t) for p in [probability(context, node)]) for t in scored]


@pytest.mark.parametrize("depth", [2, 3])
def test_code_lengths(spark, depth):
    corpus = ["abracadabra abracadabra", "the cat sat on the mat", "the cat", "", "é漢", "a" * 40]
    scored = [*corpus, "the dog sat", "zzz", "\x00\x00x"]
    table = spark.createDataFrame(list(enumerate(scored)), "doc_id long, text string")
    uri = lm.train(table.where(f"doc_id < {len(corpus)}"), depth=depth)
    rows = sorted(lm.score(table, uri, depth=depth).collect())
    np.testing.assert_allclose([r.bits for r in rows], brute_ctw(corpus, scored, depth), rtol=1e-9)
    assert rows[3].bits == 0 and rows[3].bits_per_byte is None and rows[0].bits_per_byte == pytest.approx(rows[0].bits / 23)


def test_log_gamma():
    x = np.array([0.5, 1, 1.5, 7, 100.5, 1e9])
    np.testing.assert_allclose(lm._log_gamma(x), [math.lgamma(v) for v in x], rtol=1e-11, atol=1e-11)


def test_lm_odd_rows(odd, nothing, docs):
    some = odd.where("coalesce(length(text), 0) < 1000")
    rows = lm.score(odd, lm.train(some)).collect()
    assert len(rows) == odd.count()
    assert all((r.n_bytes is None) == (r.bits is None) for r in rows) and all(math.isfinite(r.bits) for r in rows if r.bits is not None)
    unseen = lm.score(some, lm.train(nothing)).where("n_bytes > 0").collect()
    assert unseen and all(r.bits_per_byte == pytest.approx(8) for r in unseen)
    assert lm.score(nothing, lm.train(some)).count() == 0
