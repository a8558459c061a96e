"""Token counts of huge documents by overlap resynchronisation.

A document above ``chunk_bytes`` is cut into chunks that overlap. Each chunk is encoded by
itself, with the byte offset of every token. A chunk's first tokens may differ from those of
the whole text, as it begins in mid-word, and so may its last ones. Two neighbours are
spliced at a byte position in their overlap that is

* a token boundary in both encodings, and
* a proven boundary of the split pattern: between two characters of different classes (letter,
  digit, white space, other) of which the first isn't white space and neither is an apostrophe or
  a letter near one, or between a character that isn't white space and a single space that
  another such character follows. The pattern never matches across such a place, wherever
  matching began, so what is left of it and what is right of it are encoded independently of
  each other; a margin to the left chunk's end rules out that its last word is cut off.

If the overlap has no such place, it is doubled, four times at most: a word longer than that
isn't cut at all. The left chunk then goes on to the next proven boundary of the text, which is
searched forward without encoding anything, so an endless word is encoded once. The count is the
left chunk's tokens before the place and the right chunk's after it. It equals that of encoding
the whole text.

Defined cases. A null text has a null count, the empty text 0. Rows are independent: repeats,
ties and extra columns don't matter. A text without any such place (one endless word) is
encoded whole, and ``widened`` says how often overlaps grew.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vectorframe.llm.bpe import WHITE, Tokenizer, character_classes, tokenizer
from vectorframe.llm.shared import pieces, text_bytes

#: Bytes of a chunk, of the first overlap, and left out at a chunk's end.
CHUNK_BYTES, OVERLAP_BYTES, MARGIN_BYTES = 32 << 10, 256, 16
#: Overlaps tried before a word is taken to be endless, and how far an apostrophe's rules reach.
_TRIES, _REACH = 4, 4


def _fit(data: np.ndarray, at: int) -> int:
    """Largest character boundary up to ``at``."""
    while 0 < at < len(data) and data[at] & 0xC0 == 0x80:
        at -= 1
    return at


def _encode(t: Tokenizer, data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    ids, _ = t.encode(data, np.array([0, len(data)]))
    return ids, np.cumsum(t.lengths[ids])


def _stable(data: np.ndarray, low: int, high: int) -> np.ndarray:
    """Proven boundaries in [low, high), as byte positions; see the module."""
    low, high = _fit(data, max(low, 1)), _fit(data, min(high, len(data) - 1))
    begin = low
    for _ in range(_REACH):  # characters before and after, to see apostrophes by
        begin = _fit(data, max(begin - 1, 0))
    end = min(high + 4 * _REACH, len(data))
    end = _fit(data, end) if end < len(data) else end
    part = data[begin:end]
    if high <= low or not len(part):
        return np.zeros(0, np.int64)
    lead = np.flatnonzero((part & 0xC0) != 0x80)
    points = np.frombuffer(part.tobytes().decode("utf-8").encode("utf-32-le"), dtype=np.uint32)
    kind = character_classes()[points]
    quote = points == 39
    near = quote.copy()  # an apostrophe, or up to three characters behind one
    for k in range(1, _REACH):
        near[k:] |= quote[:-k]
    left, right = kind[:-1], kind[1:]
    word = (left != right) & (left != WHITE) & (right != WHITE) & ~near[:-1] & ~near[1:]
    after = np.append(kind[2:], WHITE)  # the class behind the character on the right
    space = (left != WHITE) & (points[1:] == 32) & (after != WHITE) & ~near[:-1]
    at = lead[1:][word | space] + begin
    return at[(at >= low) & (at < high)]


def _next_stable(data: np.ndarray, at: int, window: int = 4096) -> int:
    """The first proven boundary from ``at`` on, or the end of the text."""
    while at < len(data):
        if len(found := _stable(data, at, at + window)):
            return int(found[0])
        at, window = at + window, 2 * window
    return len(data)


def count_tokens(t: Tokenizer, data: np.ndarray, chunk: int = CHUNK_BYTES, overlap: int = OVERLAP_BYTES) -> tuple[int, int, int]:
    """Tokens of a text, chunks encoded, and how often an overlap was widened."""
    if len(data) <= chunk:
        return len(_encode(t, data)[0]), 1, 0
    total, chunks, widened = 0, 1, 0
    begin = share = 0  # of the chunk in hand, and where its share of the text begins
    end = _fit(data, chunk)
    ids, ends = _encode(t, data[begin:end])
    while end < len(data):
        both, back = np.zeros(0, np.int64), overlap
        for tries in range(_TRIES):
            start = _fit(data, max(end - back, share))
            # a place counts if the right chunk knows what comes before it and the left what comes after
            places = _stable(data, start + 1, end - MARGIN_BYTES)
            if len(places := places[np.isin(places - begin, ends)]):
                stop = _fit(data, min(start + max(chunk, 2 * back), len(data)))
                more, more_ends = _encode(t, data[start:stop])
                chunks += 1
                if len(both := places[np.isin(places - start, more_ends)]):
                    break
            widened += 1
            back *= 2
            if start <= share:
                break
        if len(both):
            cut = int(both[len(both) // 2])
            total += int(np.searchsorted(ends, cut - begin, side="right") - np.searchsorted(ends, share - begin, side="right"))
            ids, ends, begin, end, share = more, more_ends, start, stop, cut
            continue
        # one word fills the overlap: the chunk in hand goes on to where that word has ended
        begin, end = share, _next_stable(data, end)
        ids, ends = _encode(t, data[begin:end])
        chunks += 1
        if end < len(data):
            total += len(ids)
            begin = share = end
            end = _fit(data, min(begin + chunk, len(data)))
            ids, ends = _encode(t, data[begin:end])
            chunks += 1
    return total + len(ends) - int(np.searchsorted(ends, share - begin, side="right")), chunks, widened


def _counts(path: str, chunk: int, overlap: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = tokenizer(path)
        for batch in batches:
            for piece in pieces(batch, "text"):
                column = piece.column("text")
                data, offsets = text_bytes(column)
                size = np.diff(offsets)
                huge = np.flatnonzero(size > chunk)
                rest = np.flatnonzero(size <= chunk)
                n, chunks, widened = (np.zeros(len(size), dtype=np.int64) for _ in range(3))
                small, at = text_bytes(column.take(pa.array(rest))) if len(huge) else (data, offsets)
                n[rest], chunks[rest] = np.diff(t.encode(small, at)[1]), 1
                for i in huge:
                    n[i], chunks[i], widened[i] = count_tokens(t, data[offsets[i] : offsets[i + 1]], chunk, overlap)
                null = column.is_null().to_numpy(zero_copy_only=False)
                yield pa.record_batch([piece.column("doc_id"), *(pa.array(x, mask=null) for x in (n, chunks, widened))], ["doc_id", "n_tokens", "chunks", "widened"])

    return run


def token_counts(docs: DataFrame, path: str, id_column: str = "doc_id", text: str = "text", chunk_bytes: int = CHUNK_BYTES, overlap_bytes: int = OVERLAP_BYTES) -> DataFrame:
    """(doc_id, n_tokens, chunks, widened) of every row; see the module."""
    narrow = docs.select(F.col(id_column).alias("doc_id"), F.col(text).alias("text"))
    schema = T.StructType([narrow.schema["doc_id"], *(T.StructField(c, T.LongType()) for c in ("n_tokens", "chunks", "widened"))])
    return narrow.mapInArrow(_counts(path, chunk_bytes, overlap_bytes), schema)
