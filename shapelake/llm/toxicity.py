"""Toxic passages as maximum-scoring segments of token log-odds."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch

_TOKEN = re.compile(r"[^\W_]+")
#: Beside whole words, their beginnings of these lengths are units of the lexicon.
PREFIXES = (7, 6, 5)


def tokens(text: str | None) -> list[str]:
    return _TOKEN.findall((text or "").lower())


def units(word: str) -> list[str]:
    """A word and its beginnings, marked by what no word holds."""
    return [word, *beginnings(word)]


def beginnings(word: str) -> list[str]:
    """From the longest to the shortest."""
    return [f"{word[:k]}*" for k in PREFIXES if len(word) > k]


def maximal_segments(scores: np.ndarray) -> list[tuple[int, int, float]]:
    """All maximal scoring segments [start, end) in one pass (Ruzzo and Tompa 1999).

    Each candidate knows the total before it and the total at its end. A new one
    looks back for the nearest candidate with a smaller total before it; if that
    one's end total is smaller than the new end total, both and all between are
    one. Totals change little by little, so every candidate is merged once.
    """
    starts: list[int] = []
    ends: list[int] = []
    left: list[float] = []
    right: list[float] = []
    back: list[int] = []  # nearest earlier candidate with a smaller left total
    totals = np.concatenate(([0.0], np.cumsum(scores)))
    for at in np.flatnonzero(scores > 0).tolist():
        start, lo, hi = at, float(totals[at]), float(totals[at + 1])
        while True:
            j = len(left) - 1
            while j >= 0 and left[j] >= lo:
                j = back[j]
            if j < 0 or right[j] >= hi:
                break
            start, lo = starts[j], left[j]
            del starts[j:], ends[j:], left[j:], right[j:], back[j:]
        starts.append(start)
        ends.append(at + 1)
        left.append(lo)
        right.append(hi)
        back.append(j)
    return [(a, b, y - x) for a, b, x, y in zip(starts, ends, left, right, strict=True)]


@dataclass(frozen=True)
class Lexicon:
    """Scores of units, that of all other tokens, and the extreme-value parameters
    of segments in clean text."""

    weight: dict[str, float]
    other: float
    lam: float
    k: float

    def score(self, word: str) -> float:
        """The word's own score; for a word that was seldom or never seen, that of
        its longest beginning which has one."""
        own = self.weight.get(word)
        return own if own is not None else next((self.weight[u] for u in beginnings(word) if u in self.weight), self.other)

    def scores(self, words: list[str], memo: dict[str, float]) -> np.ndarray:
        out = np.empty(len(words))
        for at, word in enumerate(words):
            got = memo.get(word)
            if got is None:
                got = self.score(word)
                if len(memo) < 200_000:
                    memo[word] = got
            out[at] = got
        return out

    def normalised(self, score: float, n: int) -> float:
        """lambda S - ln(K n): minus the log of the number of such segments expected by chance."""
        return self.lam * score - np.log(self.k * max(n, 1))


@dataclass(frozen=True)
class Model:
    lexicon: Lexicon
    slope: float
    bias: float

    def probability(self, evidence: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-(self.slope * _squashed(evidence) + self.bias)))


#: Evidence of a text without words.
LEAST = -40.0


def evidence(lexicon: Lexicon, text: str | None, memo: dict[str, float]) -> tuple[float, int, list[tuple[int, int, float]]]:
    """Evidence of a whole text, its number of tokens, and its significant segments.

    A segment is significant if fewer than one such is expected by chance in a
    text of this length. Their normalised scores add up; without any, the best
    segment's counts, and without one of those the best token's.
    """
    words = tokens(text)
    if not words:
        return LEAST, 0, []
    scores = lexicon.scores(words, memo)
    best = float(scores.max())
    if best <= 0:
        return lexicon.normalised(best, len(words)), len(words), []
    found = [(a, b, lexicon.normalised(s, len(words))) for a, b, s in maximal_segments(scores)]
    good = [f for f in found if f[2] > 0]
    return float(sum(f[2] for f in good) if good else max(f[2] for f in found)), len(words), good


def _count_units(most: int):
    schema = pa.schema([("unit", pa.string()), ("toxic", pa.int64()), ("docs", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, bad = Counter(), Counter()

        def flush():
            keys = list(seen)
            out = pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), pa.array([bad[k] for k in keys], pa.int64()), pa.array([seen[k] for k in keys], pa.int64())], schema=schema)
            seen.clear()
            bad.clear()
            return out

        for batch in batches:
            for text, toxic in zip(batch.column(0), batch.column(1).to_pylist(), strict=True):
                had = {u for w in set(tokens(text.as_py())) for u in units(w)}
                seen.update(had)
                if toxic:
                    bad.update(had)
                if len(seen) > most:
                    yield flush()
        if seen:
            yield flush()

    return run


def unit_counts(rows: DataFrame, *, most: int = 400_000) -> DataFrame:
    """unit, toxic (toxic documents that hold it) and docs (all that do) over all
    rows of (text, toxic); counted in the tasks before the shuffle."""
    counted = rows.select("text", "toxic").mapInArrow(_count_units(most), "unit string, toxic long, docs long")
    return counted.groupBy("unit").agg(F.sum("toxic").alias("toxic"), F.sum("docs").alias("docs"))


def log_odds(counts: DataFrame, n_toxic: int, n_clean: int, *, prior_docs: float, least: int, z: float, least_odds: float, other: float, cap: float) -> DataFrame:
    """(unit, weight) of every word that ``least`` documents hold, and of the
    beginnings that mark toxic ones.

    Log-odds ratio with a Dirichlet prior proportional to the unit's share of all
    documents, worth ``prior_docs`` documents and half a one beside, over its
    standard deviation (Monroe, Colaresi and Quinn 2008). Units of ``z``
    deviations and ``least_odds`` score their log-odds, ``cap`` at most. All
    other words score ``other`` and their log-odds as far as they stand out from
    one deviation, but less than zero, so that segments end.
    """
    prior = F.lit(0.5) + F.lit(prior_docs) * F.col("docs") / F.lit(float(n_toxic + n_clean))
    a, b = F.col("toxic") + prior, F.col("docs") - F.col("toxic") + prior
    odds = lambda y, n: F.log(y) - F.log(F.greatest(F.lit(n + prior_docs) - y, F.lit(0.5)))
    found = counts.where(F.col("docs") >= least).withColumn("log_odds", odds(a, n_toxic) - odds(b, n_clean)).withColumn("z", F.col("log_odds") / F.sqrt(1 / a + 1 / b))
    marks = (F.col("z") >= z) & (F.col("log_odds") >= least_odds)
    shrunk = F.col("log_odds") * F.greatest(F.lit(0.0), 1 - 1 / (F.col("z") * F.col("z") + 1e-9))
    weight = F.when(marks, F.least(F.lit(cap), "log_odds")).otherwise(F.least(F.lit(other / 5), F.lit(other) + F.greatest(F.lit(3 * other), F.lit(0.1) * shrunk)))
    return found.where(marks | ~F.endswith("unit", F.lit("*"))).select("unit", weight.alias("weight"))


def extreme_value(shares: list[tuple[float, float]], other: float) -> tuple[float, float]:
    """lambda > 0 with sum of p exp(lambda s) = 1 over the scores of clean text, and
    K by the bound for one positive score in a row (Karlin and Altschul 1990).

    ``shares`` are (share of tokens, score); what they leave of 1 scores ``other``.
    If the mean is not below zero there is no such lambda; a small one stands for it."""
    rest = max(0.0, 1 - sum(p for p, _ in shares))
    f = lambda x: rest * np.exp(x * other) + sum(p * np.exp(x * s) for p, s in shares) - 1
    lo, hi = 1e-2, 1.0
    while f(hi) < 0 and hi < 50:
        hi *= 2
    for _ in range(100):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if f(mid) < 0 else (lo, mid)
    mean = rest * other + sum(p * s for p, s in shares)
    return lo, float(np.clip(-mean * (1 - np.exp(-lo)), 1e-3, 1.0))


def fit(
    docs: DataFrame,
    labels: DataFrame,
    *,
    prior_docs: float = 10.0,
    least: int = 5,
    z: float = 3.0,
    least_odds: float = 3.5,
    other: float = -0.5,
    cap: float = 8.0,
    label_rows: int = 50_000,
    sample_rows: int = 20_000,
    id_col: str = "doc_id",
    text_col: str = "text",
    label_col: str = "toxic",
) -> Model | float:
    """A model from labelled rows, or the constant score where there is nothing to learn.

    Learns from a sample of about ``label_rows`` labelled documents, by a hash of
    the id. The sample's labels go to all tasks, so texts are not shuffled. Words
    that at least ``least`` of its documents hold, and beginnings that mark toxic
    ones, make the lexicon (:func:`log_odds`), which the sample bounds. How often
    each score occurs among all tokens of about ``sample_rows`` of its documents,
    the clean ones, gives the extreme-value parameters; the same documents fit
    the step from evidence to probability.

    A repeated label counts once; an id with both labels counts as both.
    """
    known = labels.select(F.col(id_col).alias("doc_id"), F.col(label_col).cast("int").alias("toxic")).where("doc_id IS NOT NULL AND toxic IN (0, 1)").distinct()
    n, ones = known.agg(F.count(F.lit(1)), F.coalesce(F.sum("toxic"), F.lit(0))).first()
    if ones in (0, n):
        return 0.0 if n == 0 else float(ones > 0)
    parts = 1 << 20
    known = known.where(F.pmod(F.xxhash64("doc_id", F.lit(5)), F.lit(parts)) < int(min(1.0, label_rows / n) * parts))
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).join(F.broadcast(known), "doc_id")
    n, ones = rows.agg(F.count(F.lit(1)), F.coalesce(F.sum("toxic"), F.lit(0))).first()
    if ones in (0, n):
        return 0.0 if n == 0 else float(ones > 0)
    with Scratch(docs.sparkSession) as scratch:
        learned = log_odds(unit_counts(rows), ones, n - ones, prior_docs=prior_docs, least=least, z=z, least_odds=least_odds, other=other, cap=cap)
        found = scratch.write(learned, "lexicon").toArrow()  # words of the sample
    lexicon = Lexicon(dict(zip(found["unit"].to_pylist(), found["weight"].to_pylist(), strict=True)), other, 1.0, 1.0)
    sample = rows.where(F.pmod(F.xxhash64("doc_id", F.lit(3)), F.lit(parts)) < int(min(1.0, sample_rows / n) * parts))
    shares = sample.where("toxic = 0").select("text").mapInArrow(_count_scores(lexicon), "score double, n long").groupBy("score").agg(F.sum("n").alias("n")).orderBy("score").collect()
    total = sum(r["n"] for r in shares)
    lam, k = extreme_value([(r["n"] / total, r["score"]) for r in shares] if total else [(1e-6, cap)], other)
    lexicon = Lexicon(lexicon.weight, other, lam, k)
    got = scored(sample, lexicon, None).select("toxic", "evidence").toPandas().sort_values(["evidence", "toxic"])
    slope, bias = _logistic(_squashed(got["evidence"].to_numpy(float)), got["toxic"].to_numpy(float)) if len(got) else (1.0, 0.0)
    return Model(lexicon, slope, bias)


def _count_scores(lexicon: Lexicon):
    """How many tokens have each score, to one decimal."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo, seen = {}, Counter()
        for batch in batches:
            for text in batch.column(0):
                values, times = np.unique(lexicon.scores(tokens(text.as_py()), memo).round(1), return_counts=True)
                seen.update(dict(zip(values.tolist(), times.tolist(), strict=True)))
        yield pa.RecordBatch.from_arrays([pa.array(list(seen), pa.float64()), pa.array(list(seen.values()), pa.int64())], names=["score", "n"])

    return run


def _squashed(evidence: np.ndarray) -> np.ndarray:
    """Evidence with its ends drawn in, in order: no value is cut off."""
    return 20 * np.tanh(evidence / 20) + evidence / 100


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-3) -> tuple[float, float]:
    """Newton's method for one slope and a bias."""
    w, a = np.zeros(2), np.stack([x, np.ones_like(x)], 1)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -40, 40)))
        step = np.linalg.solve((a * (p * (1 - p) + 1e-9)[:, None]).T @ a + ridge * np.eye(2), a.T @ (y - p) - ridge * w)
        w = w + np.clip(step, -2, 2)
    return float(max(w[0], 1e-3)), float(w[1])


def _scorer(lexicon: Lexicon, model: Model | None):
    schema = "evidence double, n_tokens long, segments array<struct<first: int, end: int, score: double>>, score double"

    @F.pandas_udf(schema)
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        memo: dict[str, float] = {}
        for texts in batches:
            out = [evidence(lexicon, t, memo) for t in texts]
            total = np.array([o[0] for o in out], float)
            yield pd.DataFrame({"evidence": total, "n_tokens": [o[1] for o in out], "segments": [[{"first": a, "end": b, "score": s} for a, b, s in o[2]] for o in out], "score": model.probability(total) if model else total})

    return run


def scored(docs: DataFrame, lexicon: Lexicon, model: Model | None, *, text_col: str = "text") -> DataFrame:
    """``docs`` with evidence, n_tokens, segments (first and last token and
    normalised score of each significant passage) and, given a model, score.

    Columns of ``docs`` that have one of these names are replaced."""
    docs = docs.drop("evidence", "n_tokens", "segments", "score")
    wide = docs.withColumn("__toxicity", _scorer(lexicon, model)(F.col(text_col)))
    return wide.select(*(docs[c] for c in docs.columns), *(F.col(f"__toxicity.{c}").alias(c) for c in ("evidence", "n_tokens", "segments", "score")))


def classify(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", **how) -> DataFrame:
    """doc_id, score, predicted (1 if score >= 0.5), n_tokens and segments of each document.

    Null and empty texts have no segments and the least evidence. A null id is
    kept. Repeated rows are each scored. Labels that are null or not 0 or 1 are
    ignored; without labels every score is 0, with labels of one kind it is that
    label. Other columns are ignored.
    """
    model = fit(docs, labels, id_col=id_col, text_col=text_col, label_col=label_col, **how)
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    if isinstance(model, float):
        found = rows.select("doc_id", F.lit(model).alias("score"), F.lit(0).cast("long").alias("n_tokens"), F.lit(None).cast("array<struct<first: int, end: int, score: double>>").alias("segments"))
    else:
        found = scored(rows, model.lexicon, model)
    return found.select("doc_id", "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "n_tokens", "segments")


def keep_clean(docs: DataFrame, model: Model | float, *, text_col: str = "text", threshold: float = 0.5) -> DataFrame:
    """``docs`` without those whose score reaches ``threshold``; all columns are kept.

    Each row is judged by its own text, so ids may be null or repeated. Null and
    empty texts have the least evidence. A score equal to the threshold reaches
    it. A constant model keeps all rows or none; an empty table stays empty.
    """
    if isinstance(model, float):
        return docs.where(F.lit(model < threshold))
    scorer = _scorer(model.lexicon, model)
    return docs.where(scorer(F.col(text_col))["score"] < threshold)
