"""Quality classifier learned from positives and unlabelled text."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Classes of bytes: lower case, upper case, digits, white space, line feed, ends of
#: sentences, quotes and brackets, other symbols, first and later bytes beyond ASCII.
N_CLASSES = 10
_BYTE = np.full(256, 7, np.uint8)
for _k, _bytes in enumerate((b"abcdefghijklmnopqrstuvwxyz", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b" \t\r\x0b\x0c", b"\n", b".,;:?", b"'\"()[]-")):
    _BYTE[list(_bytes)] = _k
_BYTE[0xC0:] = 8
_BYTE[0x80:0xC0] = 9
N_FEATURES = N_CLASSES * N_CLASSES + 8


def features(text: str | None) -> np.ndarray:
    """How a whole text is written: shares of neighbouring byte classes, and how
    words repeat. All lie in [0, 1]; an empty text has zeros."""
    out = np.zeros(N_FEATURES, np.float32)
    data = (text or "").encode()
    kinds = _BYTE[np.frombuffer(data, np.uint8)]
    if len(kinds) > 1:
        pairs = np.bincount(kinds[:-1] * np.uint8(N_CLASSES) + kinds[1:], minlength=N_CLASSES * N_CLASSES)
        out[: N_CLASSES * N_CLASSES] = np.sqrt(pairs / (len(kinds) - 1))
    words = data.split()
    if words:
        n, distinct = len(words), set(words)
        plain = np.bincount(kinds, minlength=N_CLASSES) / len(kinds)
        again = sum(map(bytes.__eq__, words, words[1:])) if n > 1 else 0
        out[-8:] = (
            len(distinct) / n,
            len(distinct) / np.sqrt(n) / 40,
            again / n,
            plain[7],
            plain[1] / (plain[0] + plain[1] + 1e-9),
            min(1.0, (len(data) / n) / 20),
            min(1.0, np.log1p(n) / 12),
            1.0,
        )
    return out


@dataclass(frozen=True)
class Model:
    """Logistic model over standardised features and the prior it was fitted for."""

    mean: np.ndarray
    scale: np.ndarray
    weight: np.ndarray
    bias: float
    prior: float

    def score(self, x: np.ndarray) -> np.ndarray:
        z = ((x - self.mean) / self.scale) @ self.weight + self.bias
        return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def fit_nnpu(positive: np.ndarray, unlabelled: np.ndarray, prior: float, *, steps: int = 300, rate: float = 0.05, decay: float = 1e-3, plain: bool = False) -> Model:
    """Minimise the non-negative unbiased risk with the logistic loss.

    The risk of the negative class is that of the unlabelled less ``prior`` times
    that of the positives; where that falls below zero it counts as zero. If
    ``plain``, one kind is told from the other instead, both with equal weight.
    """
    both = np.concatenate([positive, unlabelled])
    mean, scale = both.mean(0), both.std(0) + 1e-2
    p, u = (positive - mean) / scale, (unlabelled - mean) / scale
    weight, bias = np.zeros(p.shape[1]), float(np.log(prior / (1 - prior)))
    m = v = np.zeros(len(weight) + 1)
    sig = lambda z: 1 / (1 + np.exp(-np.clip(z, -40, 40)))
    for t in range(1, steps + 1):
        zp, zu = p @ weight + bias, u @ weight + bias
        negative = np.logaddexp(0, zu).mean() - (0 if plain else prior * np.logaddexp(0, zp).mean())
        # derivative with respect to z of each part's loss
        as_positive, p_negative, u_negative = -(1 if plain else prior) * sig(-zp) / len(p), (0 if plain else prior) * sig(zp) / len(p), sig(zu) / len(u)
        gp, gu = (as_positive - p_negative, u_negative) if negative >= 0 else (as_positive, np.zeros(len(u)))
        grad = np.append(p.T @ gp + u.T @ gu + decay * weight, gp.sum() + gu.sum())
        m, v = 0.9 * m + 0.1 * grad, 0.99 * v + 0.01 * grad * grad
        step = rate * (0.5 * (1 + np.cos(np.pi * t / steps))) * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-8)
        weight, bias = weight - step[:-1], bias - step[-1]
    return Model(mean, scale, weight, bias, prior)


def _as_array(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        values = [features(t.as_py()) for t in batch.column(1)]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([v.tolist() for v in values], pa.list_(pa.float32()))], names=["kind", "x"])


def estimate_prior(positive: np.ndarray, unlabelled: np.ndarray, *, seed: int = 0, delta: float = 0.1) -> float:
    """Share of positives among the unlabelled rows.

    One half of both kinds fits a classifier of one against the other. Of the
    other half, the share of unlabelled rows above a threshold, over that of
    positives, bounds the prior from above; the threshold with the least bound,
    chances added, gives the estimate (Garg et al. 2021, best bin).
    """
    rng = np.random.default_rng(seed)
    found = []
    for _ in range(2):
        p, u = (x[rng.permutation(len(x))] for x in (positive, unlabelled))
        (p_fit, p), (u_fit, u) = (np.array_split(x, 2) for x in (p, u))
        if not min(map(len, (p_fit, p, u_fit, u))):
            return 0.5
        model = fit_nnpu(p_fit, u_fit, 0.5, steps=200, plain=True)
        sp, su = model.score(p), model.score(u)
        at = np.unique(np.concatenate([sp, su]))
        above_p = 1 - np.searchsorted(np.sort(sp), at, "left") / len(sp)
        above_u = 1 - np.searchsorted(np.sort(su), at, "left") / len(su)
        chance = np.sqrt(np.log(4 / delta) / 2) * (len(sp) ** -0.5 + len(su) ** -0.5)
        ok = above_p > 0
        best = np.argmin((above_u[ok] + chance) / above_p[ok])
        found.append(min(1.0, above_u[ok][best] / above_p[ok][best]))
    return float(np.mean(found))


def fit(docs: DataFrame, labels: DataFrame, *, positive_rows: int = 5_000, unlabelled_rows: int = 5_000, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", seed: int = 1) -> Model | float:
    """A model from labelled rows, or the constant score where there is nothing to learn.

    The trusted positives are about ``positive_rows`` documents of label 1, the
    unlabelled text about ``unlabelled_rows`` of all documents, whatever their
    label, both by a hash of the id; the class prior is estimated from these two
    alone. Labels of 0 are not looked at but to see whether there are any. Only
    the features of these documents reach the driver. A repeated label counts
    once; an id with both labels counts as positive. Null ids are not sampled.
    """
    known = labels.select(F.col(id_col).alias("doc_id"), F.col(label_col).cast("int").alias("quality")).where("doc_id IS NOT NULL AND quality IN (0, 1)").distinct()
    n, ones = known.agg(F.count(F.lit(1)), F.coalesce(F.sum("quality"), F.lit(0))).first()
    if ones in (0, n):
        return 0.5 if n == 0 else float(ones > 0)
    parts = 1 << 20
    among = lambda salt, rows, of: F.pmod(F.xxhash64("doc_id", F.lit(seed + salt)), F.lit(parts)) < int(min(1.0, rows / max(of, 1)) * parts)
    trusted = F.broadcast(known.where("quality = 1").where(among(0, positive_rows, ones)).select("doc_id", F.lit(1).alias("trusted")))
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).where("doc_id IS NOT NULL")
    rows = rows.withColumn("sampled", among(1, unlabelled_rows, docs.count()).cast("int")).join(trusted, "doc_id", "left")
    rows = rows.where("trusted = 1 OR sampled = 1").select((F.coalesce("trusted", F.lit(0)) + 2 * F.col("sampled")).alias("kind"), "text")
    got = rows.mapInArrow(_as_array, "kind int, x array<float>").toArrow()
    if not got.num_rows:
        return ones / n
    x = np.asarray(got["x"].combine_chunks().flatten()).reshape(got.num_rows, N_FEATURES).astype(float)
    kind = got["kind"].to_numpy()
    order = np.lexsort(np.concatenate([x.T, kind[None, :]]))  # rows come in any order; sums must not depend on it
    x, kind = x[order], kind[order]
    positive, unlabelled = x[kind % 2 == 1], x[kind >= 2]
    if not len(positive) or not len(unlabelled):
        return ones / n
    prior = estimate_prior(positive, unlabelled, seed=seed)
    return fit_nnpu(positive, unlabelled, min(max(prior, 1e-3), 1 - 1e-3))


def _scorer(model: Model):
    @F.pandas_udf("double")
    def scored(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series(np.concatenate([model.score(np.stack([features(t) for t in texts.iloc[k : k + 256]])) for k in range(0, len(texts), 256)]) if len(texts) else np.zeros(0))

    return scored


def score(docs: DataFrame, model: Model | float, *, text_col: str = "text", into: str = "score") -> DataFrame:
    """``docs`` and a score of each whole text, from 0 to 1; no shuffle. A column named ``into`` is replaced."""
    return docs.withColumn(into, F.lit(model) if isinstance(model, float) else _scorer(model)(F.col(text_col)))


def keep_good(docs: DataFrame, model: Model | float, *, text_col: str = "text", threshold: float = 0.5) -> DataFrame:
    """``docs`` whose score reaches ``threshold``; all columns are kept.

    Each row is judged by its own text, so ids may be null or repeated. Null and
    empty texts are scored by a vector of zeros. A score equal to the threshold
    stays. A constant model keeps all rows or none; an empty table stays empty.
    """
    return docs.where((F.lit(model) if isinstance(model, float) else _scorer(model)(F.col(text_col))) >= threshold)


def classify(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", **how) -> DataFrame:
    """doc_id, score and predicted (1 if score >= 0.5) of each document.

    Null and empty texts are scored by a vector of zeros; a null id is kept.
    Repeated rows are each scored. Labels that are null or not 0 or 1 are ignored. Without labels every
    score is 0.5, with labels of one kind it is that label. Other columns are
    ignored.
    """
    model = fit(docs, labels, id_col=id_col, text_col=text_col, label_col=label_col, **how)
    scored = score(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")), model)
    return scored.select("doc_id", "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
