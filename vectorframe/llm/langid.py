"""Language identification of mixed text by Viterbi over words.

Words are runs of letters. The script of a word, told from the ranges of its characters,
narrows the candidates: a Latin word can be any language trained in Latin script, a word in a
script that no trained language uses is labelled by the script (``script:cyrillic``). Each
word has a score for each trained candidate, the log probability of its character n-grams
(n = 1 to 4 with word boundaries, hashed) under the language's smoothed counts. Viterbi finds
the labels with the largest sum of scores minus ``switch_penalty`` for every change, and
maximal runs of one label are the spans.

Vectorisation. Scores are computed for the distinct words of a piece and kept in a bounded
cache; the recursion runs over all texts of a piece at once, in blocks of words: for every
block and every label to start from, the best path to every label, all blocks together, then
the blocks of a text are chained.

The model is fitted on at most ``max_labelled`` documents for each language, those with the
smallest hashes of their ids; of each, the whole text. The tables of counts have a fixed size.

Defined cases. A text without words (null, empty, digits) has no language and no spans. Ties
go to the label that sorts first. If no document is labelled, words in Latin script get
``script:latin``. Repeated rows score alike; extra columns don't matter.
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
from pyspark.sql.window import Window

from vectorframe.llm.shared import mix64, pieces, span_hashes, text_bytes, word_spans

#: First and last code point of script ranges (blocks of letters).
SCRIPTS = [
    (0x41, 0x24F, "latin"), (0x250, 0x2AF, "latin"), (0x1E00, 0x1EFF, "latin"), (0x370, 0x3FF, "greek"), (0x1F00, 0x1FFF, "greek"),
    (0x400, 0x52F, "cyrillic"), (0x530, 0x58F, "armenian"), (0x590, 0x5FF, "hebrew"), (0x600, 0x6FF, "arabic"), (0x750, 0x77F, "arabic"),
    (0x900, 0x97F, "devanagari"), (0x980, 0x9FF, "bengali"), (0xB80, 0xBFF, "tamil"), (0xC00, 0xC7F, "telugu"), (0xE00, 0xE7F, "thai"),
    (0x10A0, 0x10FF, "georgian"), (0x1100, 0x11FF, "hangul"), (0x3040, 0x309F, "kana"), (0x30A0, 0x30FF, "kana"), (0x3400, 0x4DBF, "han"),
    (0x4E00, 0x9FFF, "han"), (0xAC00, 0xD7AF, "hangul"),
]
SCRIPT_NAMES = [*dict.fromkeys(s for *_, s in SCRIPTS), "other"]

BUCKETS, ORDERS = 1 << 16, 4
#: Cost of a change of label, in nats; words of a block; words kept.
SWITCH_PENALTY, BLOCK, CACHE_WORDS = 12.0, 64, 200_000
_LETTER = np.array([chr(b).isalpha() if b < 128 else True for b in range(256)])
_NEVER = -1e18


def _script_of(points: np.ndarray) -> np.ndarray:
    low = np.array(sorted(a for a, _, _ in SCRIPTS))
    rows = sorted(SCRIPTS)
    at = np.searchsorted(low, points, side="right") - 1
    high = np.array([b for _, b, _ in rows])
    name = np.array([SCRIPT_NAMES.index(s) for *_, s in rows])
    return np.where((at >= 0) & (points <= high[at]), name[at], len(SCRIPT_NAMES) - 1)


def _ngrams(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Buckets of all n-grams of the words' characters between boundaries, the word of each, and each word's script."""
    size = end - start
    at = np.repeat(start - (np.cumsum(size) - size), size) + np.arange(size.sum())
    raw = data[at]
    word_of_byte = np.repeat(np.arange(len(start)), size)
    head = (raw & 0xC0) != 0x80
    points = np.frombuffer(raw.tobytes().decode("utf-8", "replace").encode("utf-32-le"), dtype=np.uint32).astype(np.int64)
    word = word_of_byte[head]
    scripts = _script_of(points)
    known = scripts < len(SCRIPT_NAMES) - 1
    first = np.searchsorted(word, np.arange(len(start)))
    votes = np.where(known, scripts, len(SCRIPT_NAMES) - 1)
    script = np.minimum.reduceat(votes, first) if len(first) else votes
    # a boundary before and after each word
    n = np.bincount(word, minlength=len(start)) + 2
    ends = np.cumsum(n)
    padded, owner = np.ones(int(ends[-1]), dtype=np.int64), np.repeat(np.arange(len(start)), n)
    inner = np.ones(len(padded), dtype=bool)
    inner[ends - 1] = inner[ends - n] = False
    padded[inner] = points
    out, of = [], []
    h = np.zeros(len(padded), dtype=np.uint64)
    for k in range(1, ORDERS + 1):
        h = h[: len(padded) - k + 1] * np.uint64(0x100000001B3) + padded[k - 1 :].astype(np.uint64)
        same = (owner[: len(h)] == owner[k - 1 :]) & (inner[: len(h)] if k == 1 else True)
        out.append(((mix64(h[same] + np.uint64(k)) >> np.uint64(48)).astype(np.int64)) + (k - 1) * BUCKETS)
        of.append(owner[: len(h)][same])
    return np.concatenate(out), np.concatenate(of), script


@dataclass(frozen=True)
class Model:
    """Labels (languages, then scripts without a language), n-gram log probabilities, and candidates of each script."""

    labels: tuple[str, ...]
    languages: int
    logs: np.ndarray  # (languages, ORDERS * BUCKETS)
    allowed: np.ndarray  # (scripts, labels)

    def scores(self, data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """(words, labels) scores."""
        bucket, word, script = _ngrams(data, start, end)
        out = np.zeros((len(start), len(self.labels)))
        for i in range(self.languages):
            out[:, i] = np.bincount(word, weights=self.logs[i][bucket], minlength=len(start))
        return np.where(self.allowed[script], out, _NEVER)


def fit(counts: dict[str, np.ndarray], scripts: dict[str, np.ndarray], smoothing: float = 0.5) -> Model:
    """From n-gram counts and counts of words by script, of each language."""
    languages = sorted(counts)
    uses = np.array([(scripts[x] > 0) & (scripts[x] >= 0.02 * scripts[x].sum()) for x in languages], dtype=bool).reshape(len(languages), len(SCRIPT_NAMES))
    free = [s for i, s in enumerate(SCRIPT_NAMES) if not uses[:, i].any()]
    labels = (*languages, *(f"script:{s}" for s in free))
    allowed = np.zeros((len(SCRIPT_NAMES), len(labels)), dtype=bool)
    allowed[:, : len(languages)] = uses.T
    for i, s in enumerate(free):
        allowed[SCRIPT_NAMES.index(s), len(languages) + i] = True
    logs = []
    for x in languages:
        c = counts[x].reshape(ORDERS, BUCKETS) + smoothing
        logs.append((np.log(c / c.sum(axis=1, keepdims=True)) / ORDERS).ravel())
    return Model(labels, len(languages), np.array(logs).reshape(len(languages), ORDERS * BUCKETS), allowed)


def _words(text: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Lower-case bytes of texts, their offsets, and start, end and row of each word in them."""
    data, offsets = text_bytes(pc.utf8_lower(text))
    return data, offsets, *word_spans(data, offsets, _LETTER)


def _given_places(text: pa.Array, data: np.ndarray, places: np.ndarray) -> np.ndarray:
    """Places in lower-case bytes as places in the given bytes; letters keep their order and number."""
    given, _ = text_bytes(text)
    if len(given) == len(data) and np.array_equal((given & 0xC0) == 0x80, (data & 0xC0) == 0x80):
        return places
    head = np.append((data & 0xC0) != 0x80, True)
    character = np.cumsum(head)[places] - 1  # places are where characters begin, or the end
    return np.append(np.flatnonzero((given & 0xC0) != 0x80), len(given))[character]


def train(docs: DataFrame, text: str = "text", lang: str = "lang", id_column: str = "doc_id", max_labelled: int = 500) -> Model:
    """Fit on at most ``max_labelled`` labelled documents of each language."""
    order = Window.partitionBy("lang").orderBy("h", "id")
    keyed = docs.where(F.col(lang).isNotNull() & F.col(text).isNotNull()).select(F.col(lang).alias("lang"), F.col(id_column).alias("id"), F.xxhash64(F.col(id_column)).alias("h"))
    # ids first, so that no text is sorted; the sample is bounded by the parameter
    chosen = keyed.withColumn("n", F.row_number().over(order)).where(F.col("n") <= max_labelled).select("id", "lang")
    found = docs.select(F.col(id_column).alias("id"), F.col(lang).alias("lang"), F.col(text).alias("text")).join(F.broadcast(chosen), ["id", "lang"], "left_semi")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[str, np.ndarray] = {}
        for batch in batches:
            for piece in pieces(batch, "text"):
                for x in pc.unique(piece.column("lang")).to_pylist():
                    data, _, start, end, _ = _words(piece.filter(pc.equal(piece.column("lang"), x)).column("text"))
                    if len(start):
                        bucket, _, script = _ngrams(data, start, end)
                        now = np.concatenate([np.bincount(bucket, minlength=ORDERS * BUCKETS), np.bincount(script, minlength=len(SCRIPT_NAMES))])
                        total[x] = total.get(x, 0) + now
        for x, c in total.items():
            at = np.flatnonzero(c)
            yield pa.record_batch([pa.array([x] * len(at), pa.string()), pa.array(at), pa.array(c[at])], ["lang", "bucket", "n"])

    rows = found.mapInArrow(count, "lang string, bucket long, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toPandas()  # of fixed size
    counts, scripts = {}, {}
    for x, g in rows.groupby("lang"):
        c = np.zeros(ORDERS * BUCKETS + len(SCRIPT_NAMES))
        c[g["bucket"].to_numpy()] = g["n"].to_numpy()
        counts[x], scripts[x] = c[: ORDERS * BUCKETS], c[ORDERS * BUCKETS :]
    return fit(counts, scripts)


def viterbi(scores: np.ndarray, lengths: np.ndarray, penalty: float = SWITCH_PENALTY, block: int = BLOCK) -> np.ndarray:
    """Best labels of consecutive texts of ``lengths`` words with (words, labels) ``scores``.

    Blocks of words, all together: best[s, l] of every block is the largest sum over its words
    of a path that leaves label s before the block and ends in l.
    """
    n, labels = scores.shape
    if not n:
        return np.zeros(0, dtype=np.int64)
    blocks = -(-lengths // block)
    firsts = np.repeat(np.cumsum(lengths) - lengths, blocks)
    inside = np.arange(blocks.sum()) - np.repeat(np.cumsum(blocks) - blocks, blocks)
    start = firsts + inside * block
    size = np.minimum(block, np.repeat(lengths, blocks) - inside * block)
    m = len(start)
    move = np.full((labels, labels), -penalty)
    np.fill_diagonal(move, 0.0)
    longest = int(size.max())
    kind = np.min_scalar_type(labels)
    back = np.zeros((longest, m, labels, labels), dtype=kind)
    best = np.broadcast_to(np.where(np.eye(labels, dtype=bool), 0.0, _NEVER * 1e3), (m, labels, labels)).copy()
    for i in range(longest):
        live = np.flatnonzero(size > i)
        now = best[live]
        top = now.argmax(axis=2)  # the best label to come from, if it changes
        change = np.take_along_axis(now, top[:, :, None], axis=2) - penalty
        stay = now >= change
        back[i, live] = np.where(stay, np.arange(labels), top[:, :, None])
        best[live] = np.where(stay, now, change) + scores[start[live] + i][:, None, :]
    # chain the blocks of each text
    first_block = np.cumsum(blocks) - blocks
    come = np.zeros((m, labels), dtype=kind)  # label before the block, for each label at its end
    value = np.zeros((len(lengths), labels))
    for k in range(int(blocks.max())):
        t = np.flatnonzero(blocks > k)
        b = first_block[t] + k
        # before the first block any label may have been left, at no cost: start from each and change freely
        reach = value[t][:, :, None] + best[b]
        come[b] = reach.argmax(axis=1)
        value[t] = reach.max(axis=1)
    end = np.zeros(m, dtype=np.int64)
    before = np.zeros(m, dtype=np.int64)
    now = value.argmax(axis=1)
    for k in range(int(blocks.max()) - 1, -1, -1):
        t = np.flatnonzero(blocks > k)
        b = first_block[t] + k
        end[b] = now[t]
        before[b] = come[b, now[t]]
        now[t] = before[b]
    out = np.zeros(n, dtype=np.int64)
    now = end.copy()
    for i in range(longest - 1, -1, -1):
        live = np.flatnonzero(size > i)
        out[start[live] + i] = now[live]
        now[live] = back[i, live, before[live], now[live]]
    return out


class Labeller:
    """A model with a bounded cache of word scores by hash."""

    def __init__(self, model: Model):
        self.model, self.slot = model, {}
        self.table = np.zeros((1 << 12, len(model.labels)))

    def label(self, data: np.ndarray, start: np.ndarray, end: np.ndarray, row: np.ndarray, rows: int, penalty: float) -> np.ndarray:
        keys, first, where = np.unique(span_hashes(data, start, end), return_index=True, return_inverse=True)
        if len(self.slot) > CACHE_WORDS:
            self.slot.clear()
        known = keys.tolist()
        new = [i for i, k in enumerate(known) if k not in self.slot]
        if new:
            at = first[new]
            size = len(self.slot)
            while size + len(new) > len(self.table):
                self.table = np.concatenate([self.table, np.zeros_like(self.table)])
            self.table[size : size + len(new)] = self.model.scores(data, start[at], end[at])
            self.slot |= {known[i]: size + j for j, i in enumerate(new)}
        slots = np.fromiter(map(self.slot.__getitem__, known), dtype=np.int64, count=len(known))
        scores = self.table[slots]
        used = np.flatnonzero((scores > _NEVER / 2).any(axis=0))  # labels that some word can have
        lengths = np.bincount(row, minlength=rows)
        some = lengths > 0
        return used[viterbi(scores[where][:, used], lengths[some], penalty)] if len(start) else np.zeros(0, np.int64)


_SPANS = T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType()), T.StructField("lang", T.StringType())]))


def identify(docs: DataFrame, model: Model, id_column: str = "doc_id", text: str = "text", switch_penalty: float = SWITCH_PENALTY) -> DataFrame:
    """(doc_id, lang, share, spans) of every row: the label of most letters' bytes with its share
    of them, and the spans as byte positions in the text, from a first word to a last."""
    narrow = docs.select(F.col(id_column).alias("doc_id"), F.col(text).alias("text"))
    names = np.array(model.labels, dtype=object)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        labeller = Labeller(model)
        for batch in batches:
            for piece in pieces(batch, "text", 1 << 19):
                n = piece.num_rows
                data, offsets, start, end, row = _words(piece.column("text"))
                found = labeller.label(data, start, end, row, n, switch_penalty)
                size = np.zeros((n, len(names)))
                np.add.at(size, (row, found), end - start)
                total, top = size.sum(axis=1), size.argmax(axis=1)
                none = total == 0
                first = np.flatnonzero((np.diff(row, prepend=-1) != 0) | (np.diff(found, prepend=-1) != 0)) if len(row) else np.zeros(0, np.int64)
                last = np.append(first[1:], len(row)) - 1 if len(first) else first
                bounds = np.searchsorted(row[first], np.arange(n + 1)) if len(first) else np.zeros(n + 1, np.int64)
                column = piece.column("text")
                of = text_bytes(column)[1][row[first]] if len(first) else first
                begin, stop = (_given_places(column, data, x) if len(first) else first for x in (start[first], end[last]))
                spans = pa.StructArray.from_arrays([pa.array(begin - of), pa.array(stop - of), pa.array(names[found[first]], pa.string())], ["start", "end", "lang"])
                yield pa.record_batch([
                    piece.column("doc_id"), pa.array(names[top], pa.string(), mask=none),
                    pa.array(np.divide(size.max(axis=1, initial=0), total, out=np.zeros(n), where=total > 0), mask=none), pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), spans),
                ], ["doc_id", "lang", "share", "spans"])

    schema = T.StructType([narrow.schema["doc_id"], T.StructField("lang", T.StringType()), T.StructField("share", T.DoubleType()), T.StructField("spans", _SPANS)])
    return narrow.mapInArrow(run, schema)

