"""Byte-level BPE encoding and decoding by speculation and verification.

A tokenizer is a file of ranks (base64 bytes and rank on each line); its path is a parameter
and the file is read by each worker, never copied.

1. Split. The words (pre-tokens) of a whole piece of text are found by array operations on
   code points: maximal runs of letters, digits, white space and others, with the rules of
   the usual split pattern for single spaces and English contractions.
2. Speculate. Each distinct word not met before is cut greedily into the longest tokens.
3. Verify. A sequence of tokens is what merging gives exactly if every adjacent pair is
   compatible, that is, if merging the bytes of the pair gives the pair. All pairs of all new
   words are tested together by walking their merge trees with array operations.
4. Only words with an incompatible pair are merged step by step.
5. Decode. Ids are turned back into bytes by one gather and compared with the piece: the round
   trip is checked for every text, so a hash collision between words cannot pass unseen (such
   a text is encoded again word by word).

Words are kept by 64-bit hash in a bounded cache; emptying it changes no result.

Defined cases. A null text has null tokens; the empty text has none. Rows are independent, so
repeats, ties and extra columns don't matter; bytes that no rank covers can't occur, as the
256 single bytes are required.
"""

from __future__ import annotations

import base64
import sys
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vectorframe.llm.shared import pieces, span_hashes, text_bytes

#: Tokens kept for distinct words before the cache is emptied.
CACHE_WORDS = 400_000

_O, _L, _N, _S = 0, 1, 2, 3
#: Class of white space.
WHITE = _S
_WHITE = [9, 10, 11, 12, 13, 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]


def _character_classes() -> np.ndarray:
    out = np.zeros(sys.maxunicode + 1, dtype=np.uint8)
    for c in range(sys.maxunicode + 1):
        kind = unicodedata.category(chr(c))[0]
        out[c] = _L if kind == "L" else _N if kind == "N" else _O
    out[_WHITE] = _S
    return out


_classes: list[np.ndarray] = []


def character_classes() -> np.ndarray:
    """Class of each code point: letter, digit, white space or other."""
    if not _classes:
        _classes.append(_character_classes())
    return _classes[0]


def split(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and row of the words of UTF-8 texts, as byte positions in ``data``.

    The pattern, tried from left to right at every position: 's 't 're 've 'm 'll 'd; letters,
    digits or other characters, each with one leading space if there is one; white space
    up to but not including its last character before something else; white space.
    """
    if not len(data):
        z = np.zeros(0, dtype=np.int64)
        return z, z, z
    lead = np.flatnonzero((data & 0xC0) != 0x80)  # byte position of each character
    points = np.frombuffer(data.tobytes().decode("utf-8").encode("utf-32-le"), dtype=np.uint32)
    kind = character_classes()[points]
    n = len(points)
    edge = np.zeros(n + 1, dtype=bool)  # texts begin and end here
    edge[np.searchsorted(lead, offsets)] = True
    begin = edge.copy()
    begin[1:-1] |= kind[1:] != kind[:-1]
    # the last character of white space before something else in the same text
    before = np.zeros(n, dtype=bool)
    before[:-1] = (kind[:-1] == _S) & (kind[1:] != _S) & ~edge[1:-1]
    begin[:-1] |= before
    # a space there joins what follows
    joins = np.flatnonzero(before & (points == 32))
    begin[joins + 1] = False
    # contractions: an apostrophe that begins a word and is followed by small letters
    for a in np.flatnonzero((points == 39) & begin[:-1]):
        rest = "".join(map(chr, points[a + 1 : a + 3]))
        for tail in ("re", "ve", "ll", "s", "t", "m", "d"):
            if rest.startswith(tail) and not edge[a + 1 : a + 1 + len(tail)].any():
                begin[a + 1 : a + 1 + len(tail)] = False
                end = a + 1 + len(tail)
                begin[end] = True
                if end < n and kind[end] == _S and before[end] and points[end] == 32:
                    begin[end + 1] = False
                break
    starts = np.flatnonzero(begin[:-1])
    start = lead[starts]
    end = np.append(start[1:], len(data))
    return start, end, np.searchsorted(offsets, start, side="right") - 1


class Tokenizer:
    """Ranks with their merge tree, and a cache of encoded words."""

    def __init__(self, path: str):
        lines = open(path, "rb").read().split()
        self.rank = {base64.b64decode(a): int(b) for a, b in zip(lines[::2], lines[1::2])}
        self.size = max(self.rank.values()) + 1
        self.token = [b""] * self.size
        for t, r in self.rank.items():
            self.token[r] = t
        missing = [b for b in range(256) if bytes([b]) not in self.rank]
        if missing:
            raise ValueError(f"no ranks for the bytes {missing}")
        self.lengths = np.array([len(t) for t in self.token], dtype=np.int64)
        self.at = np.concatenate([[0], np.cumsum(self.lengths)])
        self.bytes = np.frombuffer(b"".join(self.token), dtype=np.uint8)
        # merge tree: the two tokens that each token is merged from (itself if a single byte)
        self.left, self.right = np.arange(self.size), np.arange(self.size)
        for t, r in self.rank.items():
            if len(t) > 1:
                parts = self.merge(t, r)
                if len(parts) == 2:
                    self.left[r], self.right[r] = parts
        self.whole = (self.lengths == 1) | (self.left != np.arange(self.size))
        keys = self.left * self.size + self.right
        made = np.flatnonzero(self.left != np.arange(self.size))
        order = np.argsort(keys[made])
        self.pair_keys, self.pair_ids = keys[made][order], made[order]
        self.byte_ids = np.array([self.rank[bytes([b])] for b in range(256)], dtype=np.int64)
        nodes, edges, accepts = 1, {}, [-1]
        for t, r in self.rank.items():
            at = 0
            for b in t:
                if (to := edges.get(at * 256 + b)) is None:
                    to = edges[at * 256 + b] = nodes
                    nodes += 1
                    accepts.append(-1)
                at = to
            accepts[at] = r
        self.trie_keys = np.array(sorted(edges), dtype=np.int64)
        self.trie_nodes = np.array([edges[k] for k in self.trie_keys.tolist()], dtype=np.int64)
        self.accepts = np.array(accepts, dtype=np.int64)
        self.clear()

    def clear(self) -> None:
        self.slot: dict[int, int] = {}
        self.pool = np.zeros(1 << 16, dtype=np.int32)
        self.used = 0
        self.starts = np.zeros(1 << 14, dtype=np.int64)
        self.counts = np.zeros(1 << 14, dtype=np.int64)

    def merge(self, word: bytes, below: int | None = None) -> list[int]:
        """Exact merging: the adjacent pair of lowest rank (below ``below``), leftmost first, until none is left."""
        parts = [word[i : i + 1] for i in range(len(word))]
        if len(parts) > 200:
            return self._merge_long(parts, below)
        none = 1 << 60
        while len(parts) > 1:
            ranks = [self.rank.get(a + b, none) for a, b in zip(parts, parts[1:])]
            low = min(ranks)
            if low == none or (below is not None and low >= below):
                break
            i = ranks.index(low)
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
        return [self.rank[p] for p in parts]

    def _merge_long(self, parts: list[bytes], below: int | None) -> list[int]:
        """The same by a heap over linked neighbours, for words of any length."""
        import heapq

        n = len(parts)
        after, prior, alive = [*range(1, n), -1], [-1, *range(n - 1)], [True] * n
        heap = [(r, i, len(parts[i]) + len(parts[i + 1])) for i in range(n - 1) if (r := self.rank.get(parts[i] + parts[i + 1])) is not None]
        heapq.heapify(heap)
        while heap:
            r, i, size = heapq.heappop(heap)
            j = after[i]
            if not alive[i] or j < 0 or len(parts[i]) + len(parts[j]) != size or self.rank.get(parts[i] + parts[j]) != r:
                continue
            if below is not None and r >= below:
                break
            parts[i] += parts[j]
            alive[j] = False
            after[i] = after[j]
            if after[j] >= 0:
                prior[after[j]] = i
            for a, b in ((prior[i], i), (i, after[i])):
                if a >= 0 and b >= 0 and (x := self.rank.get(parts[a] + parts[b])) is not None:
                    heapq.heappush(heap, (x, a, len(parts[a]) + len(parts[b])))
        return [self.rank[p] for p, ok in zip(parts, alive) if ok]

    def greedy(self, data: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Longest tokens of many words: their ids in order of the words, and how many each has.

        All words walk down the trie of tokens together, a byte a step; one that can go no
        further yields the longest token passed and starts again behind it.
        """
        word, p, fin = np.arange(len(start)), start.copy(), end.copy()
        node, best, best_p = np.zeros(len(start), np.int64), np.full(len(start), -1, np.int64), start.copy()
        words, tokens, last = [], [], len(data) - 1
        while len(word):
            key = node * 256 + data[np.minimum(p, last)]
            at = np.minimum(np.searchsorted(self.trie_keys, key), len(self.trie_keys) - 1)
            hit = (p < fin) & (self.trie_keys[at] == key)
            node = np.where(hit, self.trie_nodes[at], node)
            p += hit
            accepts = self.accepts[node]
            took = hit & (accepts >= 0)
            best, best_p = np.where(took, accepts, best), np.where(took, p, best_p)
            stop = np.flatnonzero(~hit)
            if len(stop):
                words.append(word[stop])
                tokens.append(best[stop])
                p[stop], node[stop], best[stop] = best_p[stop], 0, -1
                go = hit | (p < fin)
                if not go.all():
                    word, p, fin, node, best, best_p = (x[go] for x in (word, p, fin, node, best, best_p))
        of = np.concatenate(words)
        order = np.argsort(of, kind="stable")
        return np.concatenate(tokens)[order], np.bincount(of, minlength=len(start))

    def _pair(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Token that each pair merges to, or a number above all tokens."""
        key = a * self.size + b
        at = np.minimum(np.searchsorted(self.pair_keys, key), len(self.pair_keys) - 1)
        return np.where((self.pair_keys[at] == key) & (a >= 0) & (b >= 0), self.pair_ids[at], self.size)

    def merge_all(self, data: np.ndarray, start: np.ndarray, end: np.ndarray) -> list[list[int]]:
        """Exact merging of many words of like length: one merge in each word at a time."""
        width = int((end - start).max())
        cell = start[:, None] + np.arange(width)
        m = np.where(cell < end[:, None], self.byte_ids[data[np.minimum(cell, len(data) - 1)]], -1)
        ranks = self._pair(m[:, :-1], m[:, 1:])
        found: list[list[int]] = [[] for _ in start]
        word = np.arange(len(start))
        while len(word):
            j = ranks.argmin(axis=1) if ranks.shape[1] else np.zeros(len(word), np.int64)
            low = ranks[np.arange(len(word)), j] if ranks.shape[1] else np.full(len(word), self.size)
            over = low >= self.size
            for i, row in zip(word[over].tolist(), m[over].tolist()):
                found[i] = [x for x in row if x >= 0]
            word, m, ranks, j, low = word[~over], m[~over], ranks[~over], j[~over], low[~over]
            if not len(word):
                break
            rows = np.arange(len(word))
            m[rows, j] = low
            cols = np.arange(m.shape[1] - 1)
            m = np.take_along_axis(m, cols + (cols > j[:, None]), axis=1)
            cols = np.arange(ranks.shape[1] - 1)
            ranks = np.take_along_axis(ranks, cols + (cols >= j[:, None]), axis=1)
            for k in (j - 1, j):
                ok = (k >= 0) & (k < ranks.shape[1])
                r, k = rows[ok], k[ok]
                ranks[r, k] = self._pair(m[r, k], m[r, k + 1])
        return found

    def compatible(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """For each pair of tokens, whether merging their bytes together gives the pair.

        Merges are undone from the later one on, on the side of the boundary; if at some point
        the two tokens facing each other could merge earlier than what was undone, the merge
        would have crossed the boundary.
        """
        a, b = a.astype(np.int64), b.astype(np.int64)
        good = self.whole[a] & self.whole[b]
        live = np.flatnonzero(good)
        a, b = a[live], b[live]
        limit = np.full(len(live), 1 << 60, dtype=np.int64)
        while len(live):
            key = a * self.size + b
            at = np.minimum(np.searchsorted(self.pair_keys, key), len(self.pair_keys) - 1)
            crosses = (self.pair_keys[at] == key) & (self.pair_ids[at] < limit)
            good[live[crosses]] = False
            undo_a = a > b  # the later merge; on equal ranks the right one came later
            single_a, single_b = self.right[a] == a, self.left[b] == b
            undo_a = np.where(undo_a, ~single_a, single_b & ~single_a)
            done = single_a & single_b
            # an undone left token bounds merges strictly; a right one lets its own rank through
            limit = np.where(undo_a, a, b + 1)
            a, b = np.where(undo_a, self.right[a], a), np.where(undo_a, b, self.left[b])
            stay = ~(crosses | done)
            live, a, b, limit = live[stay], a[stay], b[stay], limit[stay]
        return good

    def learn(self, hashes: list[int], data: np.ndarray, start: np.ndarray, end: np.ndarray) -> None:
        """Encode new words (spans of ``data``) and put them in the cache."""
        flat, sizes = self.greedy(data, start, end)
        ends = np.cumsum(sizes)
        pair = np.ones(max(len(flat) - 1, 0), dtype=bool)
        pair[ends[:-1] - 1] = False  # no pairs across words
        at = np.flatnonzero(pair)
        keys, where = np.unique(flat[at] * self.size + flat[at + 1], return_inverse=True)
        bad = ~self.compatible(keys // self.size, keys % self.size)[where]
        failing = np.unique(np.searchsorted(ends, np.concatenate([at[bad], np.flatnonzero(~self.whole[flat])]), side="right"))
        listed = flat.tolist()
        found = [listed[e - n : e] for e, n in zip(ends.tolist(), sizes.tolist())]
        size, low = (end - start)[failing], 0
        for high in (8, 12, 16, 24, 40, 64):  # words of like length together
            some = failing[(size > low) & (size <= high)]
            for a in range(0, len(some), 20000):
                for i, f in zip(some[a : a + 20000].tolist(), self.merge_all(data, start[some[a : a + 20000]], end[some[a : a + 20000]])):
                    found[i] = f
            low = high
        for i in failing[size > low].tolist():
            found[i] = self.merge(data[start[i] : end[i]].tobytes())
        self.verified, self.merged = len(start) - len(failing), len(failing)
        for h, f in zip(hashes, found):
            n = len(self.slot)
            while self.used + len(f) > len(self.pool):
                self.pool = np.concatenate([self.pool, np.zeros_like(self.pool)])
            if n == len(self.starts):
                self.starts, self.counts = (np.concatenate([x, np.zeros_like(x)]) for x in (self.starts, self.counts))
            self.pool[self.used : self.used + len(f)] = f
            self.starts[n], self.counts[n] = self.used, len(f)
            self.used += len(f)
            self.slot[h] = n

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts in a row, and offsets of each text into them."""
        start, end, row = split(data, offsets)
        if not len(start):
            return np.zeros(0, np.int32), np.zeros(len(offsets), np.int64)
        keys, first, where = np.unique(span_hashes(data, start, end), return_index=True, return_inverse=True)
        if len(self.slot) > CACHE_WORDS:
            self.clear()
        known = keys.tolist()
        new = [i for i, k in enumerate(known) if k not in self.slot]
        if new:
            at = first[new]
            self.learn([known[i] for i in new], data, start[at], end[at])
        slots = np.fromiter(map(self.slot.__getitem__, known), dtype=np.int64, count=len(known))[where]
        count = self.counts[slots]
        ends = np.cumsum(count)
        ids = self.pool[np.repeat(self.starts[slots] - (ends - count), count) + np.arange(ends[-1])]
        bounds = np.concatenate([[0], ends])[np.searchsorted(start, offsets)]
        raw, raw_offsets = self.decode(ids, bounds)
        if len(raw) != len(data) or not np.array_equal(raw, data):
            return self._encode_plainly(data, start, end, offsets)
        return ids, bounds

    def _encode_plainly(self, data, start, end, offsets) -> tuple[np.ndarray, np.ndarray]:
        whole, cache = data.tobytes(), {}
        found = []
        for s, e in zip(start, end):
            w = whole[s:e]
            if w not in cache:
                cache[w] = self.merge(w)
            found.append(cache[w])
        ends = np.concatenate([[0], np.cumsum([len(f) for f in found])])
        return np.array([t for f in found for t in f], dtype=np.int32), ends[np.searchsorted(start, offsets)]

    def decode(self, ids: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Bytes of the texts, and offsets into them."""
        if not len(ids):
            return np.zeros(0, np.uint8), np.zeros(len(bounds), np.int64)
        size = self.lengths[ids]
        ends = np.cumsum(size)
        raw = self.bytes[np.repeat(self.at[ids] - (ends - size), size) + np.arange(ends[-1])]
        return raw, np.concatenate([[0], ends])[bounds]


_loaded: dict[str, Tokenizer] = {}


def tokenizer(path: str) -> Tokenizer:
    """The tokenizer of a rank file, read once by each worker."""
    if path not in _loaded:
        _loaded[path] = Tokenizer(path)
    return _loaded[path]


def encoded(path: str):
    """Arrow UDF: text to token ids."""

    @F.arrow_udf(T.ArrayType(T.IntegerType()))
    def encode(text: pa.Array) -> pa.Array:
        t, out = tokenizer(path), []
        for piece in pieces(pa.record_batch([text], ["text"]), "text"):
            column = piece.column(0)
            ids, bounds = t.encode(*text_bytes(column))
            missing = column.is_null().to_numpy(zero_copy_only=False)
            out.append(pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32), mask=np.append(missing, False)), pa.array(ids)))
        return pa.concat_arrays(out) if out else pa.array([], pa.list_(pa.int32()))

    return encode


def decoded(path: str):
    """Arrow UDF: token ids to text; null for ids that aren't the tokens of a UTF-8 text."""

    @F.arrow_udf(T.StringType())
    def decode(tokens: pa.Array) -> pa.Array:
        t, out = tokenizer(path), []
        for x in tokens.to_pylist():
            try:
                out.append(None if x is None else b"".join([t.token[i] if 0 <= i < t.size else b"\xff" for i in x]).decode("utf-8"))
            except (UnicodeDecodeError, TypeError):
                out.append(None)
        return pa.array(out, pa.string())

    return decode


def _encode_batches(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = tokenizer(path)
        for batch in batches:
            for piece in pieces(batch, "text"):
                column = piece.column("text")
                data, offsets = text_bytes(column)
                ids, bounds = t.encode(data, offsets)
                raw, back = t.decode(ids, bounds)
                same = np.array_equal(back, offsets) and np.array_equal(raw, data)
                missing = column.is_null().to_numpy(zero_copy_only=False)
                tokens = pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32), mask=np.append(missing, False)), pa.array(ids))
                whole = [bool(same or np.array_equal(raw[back[i] : back[i + 1]], data[offsets[i] : offsets[i + 1]])) for i in range(len(missing))]
                yield pa.record_batch([piece.column("doc_id"), tokens, pa.array(np.diff(bounds), mask=missing), pa.array(whole, mask=missing)], ["doc_id", "tokens", "n_tokens", "round_trip"])

    return run


def encode_documents(docs: DataFrame, path: str, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, tokens, n_tokens, round_trip) of every row: ids, their number, and whether decoding them gives the text back."""
    narrow = docs.select(F.col(id_column).alias("doc_id"), F.col(text).alias("text"))
    schema = T.StructType([narrow.schema["doc_id"], T.StructField("tokens", T.ArrayType(T.IntegerType())), T.StructField("n_tokens", T.LongType()), T.StructField("round_trip", T.BooleanType())])
    return narrow.mapInArrow(_encode_batches(path), schema)
