"""Quality classifier: regularised quadratic discriminant analysis.

Each text becomes a vector of document statistics, taken from the bytes of whole texts in
Arrow batches and transformed (logarithms of sizes, log odds of shares). A Gaussian is
fitted for each class with a covariance shrunk towards the pooled one (``lam``) and towards
a multiple of the identity (``gamma``). The score is the difference of Mahalanobis log
densities, log p(good) - log p(bad), priors included, computed with the inverse Cholesky
factors cached in the model; a text is accepted if its score is at least ``threshold``.

The model is fitted on at most ``max_labelled`` labelled rows, those with the smallest hashes
of their ids; this bound, and the fixed number of statistics, is all that reaches the driver.

Defined cases. A text without words (null, empty, white space) has no score and is rejected.
Labels that are null count as missing; a document labelled twice counts twice. If either
class has fewer than two labelled documents, no model can be fitted: scores are 0 and every
text with words is accepted. Repeated rows score alike. Extra columns pass through.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vectorframe.llm.shared import fresh, pieces, row_keys, row_sums, span_hashes, text_bytes, word_spans

STATISTICS = (
    "log_bytes", "letters", "upper", "digits", "spaces", "symbols", "punctuation", "log_word", "word_spread",
    "log_distinct", "repeats", "duplicate_lines", "lines", "symbol_ends",
)

_byte = np.arange(256)
_LETTER = np.array([chr(b).isalpha() if b < 128 else True for b in _byte])
_UPPER = (_byte >= 65) & (_byte <= 90)
_DIGIT = (_byte >= 48) & (_byte <= 57)
_SPACE = np.isin(_byte, [9, 10, 11, 12, 13, 32])
_PUNCT = np.isin(_byte, list(b".,;:'\"?-()"))
_SYMBOL = ~(_LETTER | _DIGIT | _SPACE | _PUNCT) & (_byte > 32)
#: One bit for each class, so that one look-up serves all.
_CLASSES = (_LETTER, _UPPER, _DIGIT, _SPACE, _SYMBOL, _PUNCT)


def _logit(part: np.ndarray, whole: np.ndarray) -> np.ndarray:
    return np.log((part + 0.5) / (whole - part + 0.5))


def statistics(text: pa.Array) -> np.ndarray:
    """(n, len(STATISTICS)) transformed statistics; a row of NaN for a text without words."""
    n = len(text)
    data, offsets = text_bytes(text)
    out = np.full((n, len(STATISTICS)), np.nan)
    if not len(data):
        return out
    sums = []
    size = np.diff(offsets).astype(float)
    for of in _CLASSES:
        running = np.zeros(len(data) + 1, dtype=np.int32)
        np.cumsum(of[data], dtype=np.int32, out=running[1:])
        sums.append((running[offsets[1:]] - running[offsets[:-1]]).astype(float))
    letters, upper, digits, spaces, symbols, punct = sums
    start, end, row = word_spans(data, offsets, ~_SPACE)
    if not len(start):
        return out
    words = row_sums(np.ones(len(row)), row, n)
    length = (end - start).astype(float)
    mean = row_sums(length, row, n) / np.maximum(words, 1)
    spread = np.sqrt(np.maximum(row_sums(length**2, row, n) / np.maximum(words, 1) - mean**2, 0))
    h = span_hashes(data, start, end)
    # distinct (row, word): the first of each run of equal words, counted in its row
    order = np.argsort(row_keys(h, row))
    hs, rs = h[order], row[order]
    first = np.ones(len(hs), dtype=bool)
    first[1:] = (hs[1:] != hs[:-1]) | (rs[1:] != rs[:-1])
    distinct = row_sums(np.ones(int(first.sum())), rs[first], n)
    again = (h[1:] == h[:-1]) & (row[1:] == row[:-1])
    repeats = row_sums(again.astype(float), row[1:], n)
    ends = row_sums(_SYMBOL[data[end - 1]].astype(float), row, n)
    ls, le, lrow = word_spans(data, offsets, _byte != 10)
    lh = span_hashes(data, ls, le)
    order = np.lexsort((lh, lrow))
    lh, lr, ll = lh[order], lrow[order], (le - ls)[order].astype(float)
    copy = np.zeros(len(lh), dtype=bool)
    copy[1:] = (lh[1:] == lh[:-1]) & (lr[1:] == lr[:-1])
    copied = row_sums(ll * copy, lr, n)
    lines = row_sums(np.ones(len(lr)), lr, n)
    some = words > 0
    out[some] = np.stack([
        np.log1p(size), _logit(letters, size), _logit(upper, np.maximum(letters, upper)), _logit(digits, size), _logit(spaces, size),
        _logit(symbols, size), _logit(punct, size), np.log(np.maximum(mean, 1e-9)), np.log1p(spread), np.log((distinct + 1) / (words + 1)),
        _logit(repeats, np.maximum(words, repeats)), _logit(copied, size), np.log1p(lines) - np.log1p(words), _logit(ends, words),
    ], axis=1)[some]
    return out


@dataclass(frozen=True)
class Model:
    """Means, inverse Cholesky factors and log constants of both classes (0 bad, 1 good)."""

    means: tuple[np.ndarray, np.ndarray]
    factors: tuple[np.ndarray, np.ndarray]
    constants: tuple[float, float]

    def score(self, x: np.ndarray) -> np.ndarray:
        """log p(good, x) - log p(bad, x); NaN where x is."""
        density = [c - 0.5 * (((x - m) @ f.T) ** 2).sum(axis=1) for m, f, c in zip(self.means, self.factors, self.constants)]
        return density[1] - density[0]


def fit(x: np.ndarray, good: np.ndarray, lam: float = 0.8, gamma: float = 0.05) -> Model | None:
    """Fit on statistics ``x`` and truth values ``good``; None if a class has fewer than two rows."""
    keep = np.isfinite(x).all(axis=1)
    x, good = x[keep], good[keep]
    if min(good.sum(), (~good).sum()) < 2:
        return None
    scale = x.std(axis=0) + 1e-6
    parts = [x[~good], x[good]]
    means = [p.mean(axis=0) for p in parts]
    covariances = [np.cov((p / scale).T) for p in parts]
    pooled = sum(c * (len(p) - 1) for c, p in zip(covariances, parts)) / (len(x) - 2)
    factors, constants = [], []
    for c, p in zip(covariances, parts):
        c = (1 - lam) * c + lam * pooled
        c = (1 - gamma) * c + gamma * (np.trace(c) / len(c) + 1e-9) * np.eye(len(c))
        root = np.linalg.cholesky(c)
        factors.append(np.linalg.inv(root) / scale)  # cached: scoring is one product for each class
        constants.append(float(np.log(len(p) / len(x)) - np.log(np.diag(root)).sum()))
    return Model(tuple(means), tuple(factors), tuple(constants))


def _per_piece(text: pa.Array, of) -> np.ndarray:
    batch = pa.record_batch([text], ["text"])
    return np.concatenate([of(p.column(0)) for p in pieces(batch, "text")] or [of(text)])


@F.arrow_udf(T.ArrayType(T.DoubleType()))
def statistics_of(text: pa.Array) -> pa.Array:
    x = _per_piece(text, statistics)
    flat = pa.array(x.ravel())
    return pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * x.shape[1]), flat)


def train(docs: DataFrame, labels: DataFrame, id_column: str = "doc_id", text: str = "text", label: str = "quality", labelled_id: str = "doc_id", max_labelled: int = 20000, lam: float = 0.8, gamma: float = 0.05) -> Model | None:
    """Fit on the documents of at most ``max_labelled`` rows of ``labels``.

    The sample is those with the smallest hashes of their ids; its size is bounded by the
    parameter, which is why it may be broadcast to the scan of the documents.
    """
    chosen = (
        labels.where(F.col(label).isNotNull() & F.col(labelled_id).isNotNull()).select(F.col(labelled_id).alias("__id"), (F.col(label) > 0).alias("__good"))
        .orderBy(F.xxhash64("__id"), "__id", "__good").limit(max_labelled)
    )
    found = docs.select(F.col(id_column).alias("__id"), F.col(text).alias("__text")).join(F.broadcast(chosen), "__id")
    # sorted here: a distributed sort would take the statistics twice
    rows = found.select("__id", "__good", statistics_of("__text").alias("__x")).toPandas().sort_values(["__id", "__good"], kind="stable")
    if not len(rows):
        return None
    return fit(np.array(rows["__x"].tolist(), dtype=float), rows["__good"].to_numpy(dtype=bool), lam, gamma)


def score(model: Model | None):
    """Arrow UDF: score of each text; null without words."""

    @F.arrow_udf(T.DoubleType())
    def scored(text: pa.Array) -> pa.Array:
        if len(text) == 0:
            return pa.array([], pa.float64())
        x = _per_piece(text, statistics)
        s = model.score(x) if model else np.where(np.isnan(x[:, 0]), np.nan, 0.0)
        return pa.array(s, from_pandas=True)

    return scored


def classify(docs: DataFrame, model: Model | None, id_column: str = "doc_id", text: str = "text", threshold: float = 0.0) -> DataFrame:
    """(doc_id, score, accepted) of every row."""
    scored = docs.select(F.col(id_column).alias("doc_id"), score(model)(F.col(text)).alias("score"))
    return scored.select("doc_id", "score", F.coalesce(F.col("score") >= threshold, F.lit(False)).alias("accepted"))


def accepted(docs: DataFrame, model: Model | None, text: str = "text", threshold: float = 0.0) -> DataFrame:
    """Rows of ``docs`` whose text is accepted; texts aren't sent back from Python."""
    name = fresh(docs, "score")
    return docs.withColumn(name, score(model)(F.col(text))).where(F.col(name) >= threshold).select(*[F.col(f"`{c}`") for c in docs.columns])
