"""Mixing sources to target weights by iterative proportional fitting.

Tokens (white-space words of whole texts, or any column of counts) are summed for each cell of source x language x
topic in one aggregation. The table of cells is raked: its weights are scaled to the source,
the language and the topic targets in turn until all three marginals agree, which gives the
token mass every cell should have. A document's probability of being kept is
``rate * wanted / present`` of its cell, with the largest rate for which no probability
exceeds one; the expected mixture then has the raked weights exactly. A document is kept if
a hash of its id and text falls below its probability, so the choice depends on neither
partitioning nor retries.

Targets default to the present shares raised to ``temperature`` (below 1: flatter). The topic
is any column expression; by default a genre told from the whole text (see ``genre``).

The number of cells is the product of the numbers of sources, languages and topics at most,
whatever the number of documents. A cell that is to grow most sets the rate of all others, so one
rare category with a raised target thins the sample. Up to ``driver_cells`` of them are raked with numpy; a
larger table is raked as a DataFrame, step by step in the shared folder, to the same result.

Defined cases. A null source, language or topic is a category of its own (written as null); a
null or blank text has no tokens, adds nothing to any marginal and shares its cell's
probability (0 in a cell without tokens). A category without target gets weight 0; a target
without documents is dropped and the others rescaled. Repeated rows are kept or dropped
together. Targets that no mixture of the cells there are can meet leave marginals that disagree
after the last of ``rounds``: the fit is the last one, its largest difference is the cells'
``marginal_error``, and a warning is given. An empty table stays empty. Extra columns pass through, whatever their names.
"""

from __future__ import annotations

import warnings

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vectorframe.llm.shared import fresh, settle, shared_dir

#: Cells raked on the driver; a larger table is raked as a DataFrame.
DRIVER_CELLS = 100_000
#: Largest difference of a marginal from its target, and most rounds.
TOLERANCE, ROUNDS = 1e-9, 200


def tokens(text: Column) -> Column:
    """White-space words of a text; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(r"\S+")), F.lit(0)).cast("long")


def genre(text: Column, words: Column) -> Column:
    """Topic told from a text: table (cells divided by bars), else brief, article or book by words."""
    bars = F.octet_length(text) - F.octet_length(F.replace(text, F.lit("|"), F.lit("")))
    return F.when(bars * 10 >= words, "table").when(words < 100, "brief").when(words < 1000, "article").otherwise("book")


def rake(mass: np.ndarray, codes: list[np.ndarray], targets: list[np.ndarray], tolerance: float = TOLERANCE, rounds: int = ROUNDS) -> tuple[np.ndarray, float]:
    """Scale ``mass`` to the targets of each coordinate in turn until every marginal agrees; the
    result, and the largest difference of a marginal from its target."""
    mass, worst = mass.astype(float).copy(), 0.0

    def off() -> float:
        return max(float(np.abs(np.bincount(c, weights=mass, minlength=len(t)) - t).max(initial=0.0)) for c, t in zip(codes, targets))

    for _ in range(rounds):
        for code, target in zip(codes, targets):
            now = np.bincount(code, weights=mass, minlength=len(target))
            mass *= np.divide(target, now, out=np.zeros_like(now), where=now > 0)[code]
        if (worst := off()) <= tolerance:
            break
    return mass, worst


def _warn(worst: float, rounds: int) -> None:
    if worst > TOLERANCE:
        warnings.warn(f"marginals differ from their targets by up to {worst:.3g} after {rounds} rounds", stacklevel=3)


def _targets(given: dict | None, shares: dict, temperature: float) -> dict:
    """Target share of each category that has tokens, summing to one."""
    wanted = {k: (given.get(k, 0.0) if given is not None else v**temperature) for k, v in shares.items() if v > 0}
    total = sum(wanted.values())
    return {k: v / total for k, v in wanted.items()} if total else {}


def _measured(docs: DataFrame, text: str, dims: list[Column], topic: Column | None, counts: Column | None) -> tuple[DataFrame, list[str], str]:
    words = fresh(docs, "tokens")
    names = [fresh(docs, n) for n in ("source", "lang", "topic")]
    out = docs.withColumn(words, tokens(F.col(f"`{text}`")) if counts is None else F.coalesce(counts.cast("long"), F.lit(0).cast("long")))
    kind = topic if topic is not None else genre(F.coalesce(F.col(f"`{text}`"), F.lit("")), F.col(words))
    for n, c in zip(names, [*dims, kind]):
        out = out.withColumn(n, c.cast("string"))
    return out, names, words


def cell_probabilities(cells: DataFrame, targets: dict[str, dict] | None = None, temperature: float = 0.9, driver_cells: int = DRIVER_CELLS, rounds: int = ROUNDS) -> DataFrame:
    """(source, lang, topic, tokens) -> the same with ``wanted`` (share of all tokens), ``probability``
    and ``marginal_error`` (of the whole fit)."""
    dims, targets = ["source", "lang", "topic"], targets or {}
    marginals = {}
    total = float(cells.agg(F.sum("tokens")).first()[0] or 0)
    for d in dims:  # one row for each category
        present = {r[0]: r[1] / total if total else 0.0 for r in cells.groupBy(d).agg(F.sum("tokens")).collect()}
        marginals[d] = _targets(targets.get(d), present, temperature)
    spark = cells.sparkSession
    if cells.count() <= driver_cells:
        rows = sorted(cells.collect(), key=lambda r: [(r[d] is None, r[d] or "") for d in dims])
        mass = np.array([r["tokens"] for r in rows], dtype=float) / (total or 1.0)
        codes, wanted = [], []
        for d in dims:
            order = {k: n for n, k in enumerate(dict.fromkeys(r[d] for r in rows))}
            codes.append(np.array([order[r[d]] for r in rows], dtype=np.int64))
            wanted.append(np.array([marginals[d].get(k, 0.0) for k in order]))
        fitted, worst = rake(mass, codes, wanted, rounds=rounds) if total else (mass, 0.0)
        _warn(worst, rounds)
        ratio = np.divide(fitted, mass, out=np.zeros_like(mass), where=mass > 0)
        rate = 1 / ratio.max() if len(ratio) and ratio.max() > 0 else 0.0
        out = [(*(r[d] for d in dims), int(r["tokens"]), float(f), float(min(1.0, rate * x)), worst) for r, f, x in zip(rows, fitted, ratio)]
        return spark.createDataFrame(out, "source string, lang string, topic string, tokens long, wanted double, probability double, marginal_error double")
    folder = shared_dir(spark, "rake")
    now = settle(cells.withColumn("present", F.col("tokens") / F.lit(total or 1.0)).withColumn("wanted", F.col("present")), f"{folder}/start")
    worst = 0.0
    for step in range(rounds if total else 0):
        for d in dims:
            target = spark.createDataFrame([(k, float(v)) for k, v in marginals[d].items()], f"{d} string, target double")
            sums = now.groupBy(d).agg(F.sum("wanted").alias("sum"))
            factor = sums.join(target, sums[d].eqNullSafe(target[d]), "left").select(sums[d].alias("k"), "sum", F.coalesce("target", F.lit(0.0)).alias("target"))
            factor = factor.withColumn("factor", F.when(F.col("sum") > 0, F.col("target") / F.col("sum")).otherwise(0.0))
            now = now.join(factor.select("k", "factor"), now[d].eqNullSafe(F.col("k"))).withColumn("wanted", F.col("wanted") * F.col("factor")).drop("k", "factor")
        now = settle(now, f"{folder}/{step}")
        worst = 0.0
        for d in dims:  # one row for each category
            worst = max([worst, *(abs((r[1] or 0.0) - marginals[d].get(r[0], 0.0)) for r in now.groupBy(d).agg(F.sum("wanted")).collect())])
        if worst <= TOLERANCE:
            break
    _warn(worst, rounds)
    ratio = F.when(F.col("present") > 0, F.col("wanted") / F.col("present")).otherwise(0.0)
    top = float(now.agg(F.max(ratio)).first()[0] or 0)
    return now.select(*dims, "tokens", "wanted", F.least(F.lit(1.0), ratio * F.lit(1 / top if top else 0.0)).alias("probability"), F.lit(worst).alias("marginal_error"))


def _sampled(docs: DataFrame, source: str, lang: str, text: str, id_column: str, topic: Column | None, counts: Column | None, targets, temperature: float, seed: int) -> tuple[DataFrame, str, str]:
    measured, names, words = _measured(docs, text, [F.col(f"`{source}`"), F.col(f"`{lang}`")], topic, counts)
    cells = measured.groupBy(*names).agg(F.sum(words).alias("tokens")).toDF("source", "lang", "topic", "tokens")
    cells = settle(cells, f"{shared_dir(docs.sparkSession, 'cells')}/cells")
    p = fresh(measured, "probability")
    fitted = cell_probabilities(cells, targets, temperature).select(*[F.col(c).alias(f"{p}{c}") for c in ("source", "lang", "topic", "probability")])
    fitted = F.broadcast(fitted) if cells.count() <= DRIVER_CELLS else fitted
    same = [F.col(n).eqNullSafe(F.col(f"{p}{c}")) for n, c in zip(names, ("source", "lang", "topic"))]
    joined = measured.join(fitted, same[0] & same[1] & same[2])
    draw = (F.shiftrightunsigned(F.xxhash64(F.lit(seed), F.col(f"`{id_column}`"), F.col(f"`{text}`")), 11)).cast("double") / F.lit(float(1 << 53))
    return joined.where(draw < F.col(f"{p}probability")), words, f"{p}probability"


def mix(docs: DataFrame, targets: dict[str, dict] | None = None, temperature: float = 0.9, seed: int = 17, id_column: str = "doc_id", text: str = "text", source: str = "source", lang: str = "lang", topic: Column | None = None, counts: Column | None = None) -> DataFrame:
    """(doc_id, tokens, probability) of the documents sampled; see the module. ``topic`` and
    ``counts`` are expressions over ``docs``: a document's topic, and its number of tokens."""
    needed = docs if topic is not None or counts is not None else docs.select(*dict.fromkeys([id_column, text, source, lang]))
    kept, words, p = _sampled(needed, source, lang, text, id_column, topic, counts, targets, temperature, seed)
    return kept.select(F.col(f"`{id_column}`").alias("doc_id"), F.col(words).alias("tokens"), F.col(p).alias("probability"))


def sample(docs: DataFrame, targets: dict[str, dict] | None = None, temperature: float = 0.9, seed: int = 17, id_column: str = "doc_id", text: str = "text", source: str = "source", lang: str = "lang", topic: Column | None = None, counts: Column | None = None) -> DataFrame:
    """The rows of ``docs`` that ``mix`` samples."""
    kept, _, _ = _sampled(docs, source, lang, text, id_column, topic, counts, targets, temperature, seed)
    return kept.select(*[F.col(f"`{c}`") for c in docs.columns])
