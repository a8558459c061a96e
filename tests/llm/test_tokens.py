"""BPE and token counts against a public library, with the same ranks; exact round trips."""

from __future__ import annotations

import base64

import numpy as np
import pyarrow as pa
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from vectorframe.llm import bpe, token_counts
from vectorframe.llm.queries import RANKS
from vectorframe.llm.shared import text_bytes

MULTI = RANKS.replace("byte_bpe_50k", "byte_bpe_multi_50k")
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def library(path):
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(path, "rb"))}
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


@pytest.fixture(scope="module", params=[RANKS, MULTI])
def both(request):
    return bpe.tokenizer(request.param), library(request.param)


def encode(t, texts):
    ids, bounds = t.encode(*text_bytes(pa.array(texts, pa.string())))
    return [ids[a:b].tolist() for a, b in zip(bounds, bounds[1:])]


def test_documents(both, texts):
    t, lib = both
    assert encode(t, list(texts.values())) == [lib.encode_ordinary(x) for x in texts.values()]


CASES = [
    "", " ", "  ", "   x", "x   ", "a\n\nb", " \n x", "don't we'll I'd 're 'S's 'sx '", "x's y'll' '' ''s", "it'll've", " 'tis", "漢字かな交じり文", "٣٤٥ १२३ ½", "éá", " 　x", "👩‍👩‍👧 ok",
    "\x85x\x1c y", "a" * 3000, " " * 700 + "x", "ab" * 900, "0123456789" * 50, "<|endoftext|>", "﻿x", "tab\tsep\t\tx", "a\r\nb\r\n", "--- *** ---", "'" * 9, "​zero", "x" + " " * 3 + "\n" + "y",
]


def test_cases(both):
    t, lib = both
    assert encode(t, CASES) == [lib.encode_ordinary(x) for x in CASES]


@settings(max_examples=120, deadline=None)
@given(st.lists(st.text(st.one_of(st.characters(blacklist_categories=["Cs"]), st.sampled_from(" \n'abcdestlvrm1é")), max_size=60), min_size=1, max_size=6))
def test_any_text(texts):
    t, lib = bpe.tokenizer(RANKS), _library()
    assert encode(t, texts) == [lib.encode_ordinary(x) for x in texts]


_made = []


def _library():
    if not _made:
        _made.append(library(RANKS))
    return _made[0]


def test_compatible_pairs(both):
    """The vectorised check of a pair says what merging the pair's bytes gives."""
    t, _ = both
    rng = np.random.default_rng(3)
    a, b = rng.integers(0, t.size, 4000), rng.integers(0, t.size, 4000)
    ok = t.compatible(a, b)
    for x, y, good in zip(a.tolist(), b.tolist(), ok.tolist()):
        if t.token[x] and t.token[y]:
            assert good == (t.merge(t.token[x] + t.token[y]) == [x, y]), (x, y)


def test_most_words_need_no_merging(both, texts):
    t, _ = both
    t.clear()
    encode(t, list(texts.values()))
    assert t.verified > 0.4 * (t.verified + t.merged)  # invented words; real ones fail far less often


def test_colliding_hashes(monkeypatch):
    t = bpe.Tokenizer(RANKS)
    monkeypatch.setattr(bpe, "span_hashes", lambda data, start, end: np.zeros(len(start), np.uint64))
    assert encode(t, ["two words and more", "x"]) == [_library().encode_ordinary(x) for x in ("two words and more", "x")]


def test_encode_documents(odd, nothing):
    rows = bpe.encode_documents(odd, RANKS).collect()
    source = sorted((str(r.doc_id), r.text or "", r.text is None) for r in odd.select("doc_id", "text").collect())
    assert len(rows) == len(source)
    for r in rows:
        if r.tokens is None:
            assert r.n_tokens is None and r.round_trip is None
        else:
            assert r.round_trip and r.n_tokens == len(r.tokens)
    short = odd.where("length(coalesce(text, '')) < 1000").select("doc_id", "text").collect()
    want = sorted(((str(r.doc_id), None if r.text is None else _library().encode_ordinary(r.text)) for r in short), key=str)
    short = {i for i, _ in want}
    assert sorted(((str(r.doc_id), r.tokens) for r in rows if str(r.doc_id) in short), key=str) == want
    back = odd.select("text", bpe.encoded(RANKS)(F.col("text")).alias("x")).select("text", bpe.decoded(RANKS)(F.col("x")).alias("back"))
    assert back.where(~F.col("text").eqNullSafe(F.col("back"))).count() == 0
    bad = odd.limit(1).select(bpe.decoded(RANKS)(F.array(F.lit(10**9))).alias("x"), bpe.decoded(RANKS)(F.array(F.lit(-1))).alias("y")).first()
    assert bad.x is None and bad.y is None
    assert bpe.encode_documents(nothing, RANKS).count() == 0


# ---------------------------------------------------------------- token counts


def count(text, chunk, overlap):
    return token_counts.count_tokens(bpe.tokenizer(RANKS), np.frombuffer(text.encode(), np.uint8), chunk, overlap)


@pytest.mark.parametrize("chunk, overlap", [(64, 20), (200, 40), (1000, 64), (5000, 17)])
def test_counts(texts, chunk, overlap):
    lib = _library()
    for x in [*CASES, *list(texts.values())[:60], "x " * 900, " ".join(CASES) * 3]:
        n, chunks, _ = count(x, chunk, overlap)
        assert n == len(lib.encode_ordinary(x)), x[:50]
        assert len(x.encode()) <= chunk or chunks > 1


@settings(max_examples=80, deadline=None)
@given(st.text(st.one_of(st.sampled_from("ab c  d\n'sé漢1"), st.characters(blacklist_categories=["Cs"])), max_size=400))
def test_counts_of_any_text(text):
    assert count(text, 40, 18)[0] == len(_library().encode_ordinary(text))


def test_overlaps_widen():
    text = "word " * 40 + "y" * 300 + " word" * 40
    n, _, widened = count(text, 100, 20)
    assert widened > 0 and n == len(_library().encode_ordinary(text))


@pytest.mark.parametrize("text", ["Это обычный текст, и в нём много слов. " * 3000, "Où est né l'été à Évian? C'était là-bas. " * 3000, "漢字文章、全部漢字。" * 4000, "漢字 текст l'été 42 " * 4000], ids=["cyrillic", "french", "han", "mixed"])
def test_overlaps_agree_in_any_script(text):
    n, chunks, widened = count(text, token_counts.CHUNK_BYTES, token_counts.OVERLAP_BYTES)
    assert n == len(_library().encode_ordinary(text)) and widened == 0 and chunks <= len(text.encode()) // token_counts.CHUNK_BYTES + 3


def test_an_endless_word_is_encoded_once(monkeypatch):
    text = "some words, " * 4000 + "漢" * 30_000 + ". and words " * 4000
    done = []
    encode = token_counts._encode
    monkeypatch.setattr(token_counts, "_encode", lambda t, data: done.append(len(data)) or encode(t, data))
    n, _, widened = count(text, token_counts.CHUNK_BYTES, token_counts.OVERLAP_BYTES)
    assert n == len(_library().encode_ordinary(text)) and widened <= 8 and sum(done) <= 1.5 * len(text.encode())


def test_token_counts(odd, nothing):
    lib, want = _library(), {}
    rows = odd.select("doc_id", "text").collect()
    want = sorted((str(r.doc_id), -1 if r.text is None else len(lib.encode_ordinary(r.text))) for r in rows)
    got = token_counts.token_counts(odd, RANKS, chunk_bytes=4096).collect()
    assert sorted((str(r.doc_id), -1 if r.n_tokens is None else r.n_tokens) for r in got) == want
    assert max(r.chunks or 0 for r in got) > 10
    assert token_counts.token_counts(nothing, RANKS).count() == 0
