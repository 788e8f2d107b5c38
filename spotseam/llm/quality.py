"""Quality classifier by positive-unlabelled learning.

Trusted positives and unlabelled texts train a linear model that minimises the
non-negative unbiased risk: with class prior p, positives' loss weighs p, and the
loss of the unlabelled as negatives, less p times that of the positives as
negatives, never counts below zero.  The unlabelled are documents at large, whether someone
has labelled them or not; the prior is the share of positives among all
documents, from the scores of a first model.  No negative label takes part.
Features are of the text alone: how kinds of characters follow one another, and
how words and lines vary.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import need, portions, release

#: Trusted positives, and unlabelled documents, that the model is fitted on at most; chosen by hashes of ids and texts.
FIT_ROWS = 10_000
#: Thresholds at which the shares of positives and of all documents are compared.
CUTS = 81
THRESHOLD = 0.3
_GROUPS = ["\n", "\t\r\x0b\x0c", " ", "0123456789", "aeiou", "bcdfghjklmnpqrstvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", ".", ",", ";:", "!?", "\"'`", "-", "|", "()[]{}<>", "/\\", "@", "#", "$%&*", "+=~^_"]
KINDS = len(_GROUPS) + 3
_KIND = np.zeros(256, np.uint8)
for _i, _g in enumerate(_GROUPS):
    _KIND[np.frombuffer(_g.encode(), np.uint8)] = _i + 1
_KIND[0x80:0xC0] = len(_GROUPS) + 1
_KIND[0xC0:] = len(_GROUPS) + 2
WIDTH = KINDS * KINDS + 9
#: Characters at which a text's features count half.
SHRINK = 100


def features(text: str | None) -> np.ndarray:
    """Square roots of the shares of pairs of character kinds, and nine figures of words and lines."""
    text = text or ""
    kinds = _KIND[np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)].astype(np.int32)
    pairs = np.bincount(kinds[:-1] * KINDS + kinds[1:], minlength=KINDS * KINDS) if len(kinds) > 1 else np.zeros(KINDS * KINDS)
    words, lines = text.split(), text.split("\n")
    n, m = max(1, len(words)), len(lines)
    distinct = len(set(words))
    long = len(max(words, key=len)) if words else 0
    rest = [np.log1p(len(text)), len(text) / n, distinct / n, np.log1p(n / m), len(set(lines)) / m, np.log1p(m), np.log1p(long), float(not words), sum(map(eq, words, words[1:])) / n]
    return np.concatenate([np.sqrt(pairs / max(1, len(kinds) - 1)), rest]).astype(np.float32)


def prior_cuts(positive: np.ndarray) -> np.ndarray:
    """Scores that a fifth of the positives and more reach."""
    return np.quantile(positive, np.linspace(0.0, 0.8, CUTS))


def class_prior(positive: np.ndarray, cuts: np.ndarray, reached: np.ndarray, every: int) -> float:
    """Share of positives among all documents, of which ``reached`` have at least the scores ``cuts``.

    Above any threshold all documents have at least the prior times the positives' share;
    the least such ratio bounds the prior.
    """
    if not len(positive) or not every:
        return 0.5
    of_positive = 1 - np.searchsorted(np.sort(positive), cuts, "left") / len(positive)
    return float(np.clip((reached / every / np.maximum(of_positive, 1e-9)).min(), 0.02, 0.98))


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(0.5 * z))


def fit_pu(positive: np.ndarray, unlabelled: np.ndarray, prior: float, steps: int = 400, rate: float = 0.03, decay: float = 0.01) -> np.ndarray:
    """Weights (bias last) by Adam on the non-negative risk with logistic loss."""
    p, u = positive, unlabelled
    w = np.zeros(p.shape[1] + 1)
    m, v = np.zeros_like(w), np.zeros_like(w)
    raw = lambda x: x @ w[:-1].astype(x.dtype) + w[-1]
    mean = lambda x, s: np.append(x.T @ s.astype(x.dtype), s.sum()) / len(x)
    for t in range(1, steps + 1):
        zp, zu = raw(p), raw(u)
        g = prior * mean(p, _sigmoid(zp) - 1)
        negative = np.logaddexp(0, zu).mean() - prior * np.logaddexp(0, zp).mean()
        down = mean(u, _sigmoid(zu)) - prior * mean(p, _sigmoid(zp))
        g = (g + down if negative >= 0 else -down) + decay * w  # below zero the risk of negatives is pushed back up
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        w = w - rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    return w


def _centred(x: np.ndarray, mean: np.ndarray, scale: np.ndarray) -> np.ndarray:
    n = np.expm1(x[:, KINDS * KINDS])[:, None]
    out = x - mean
    out /= scale
    out *= n / (n + SHRINK)
    return out


@dataclass(frozen=True)
class Model:
    """A linear model; the features of a short text say little, so they count by length / (length + SHRINK)."""

    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    prior: float

    def raw(self, x: np.ndarray) -> np.ndarray:
        return _centred(x, self.mean, self.scale) @ self.weights[:-1] + self.weights[-1]

    def score(self, x: np.ndarray) -> np.ndarray:
        return _sigmoid(self.raw(x))


def held_out(id_col: Column) -> Column:
    return F.coalesce(F.crc32(id_col.cast("string")) % 5 == 0, F.lit(False))


def _featured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    release()
    for b in batches:
        for part, texts in portions(b, "text"):
            yield pa.record_batch([part.column("h"), pa.array([features(t).tobytes() for t in texts], pa.binary())], ["h", "x"])


def _sample(rows: DataFrame, limit: int) -> np.ndarray:
    """Features of the rows (h, text) with the least hashes, at most ``limit``, in that order."""
    got = rows.mapInArrow(_featured, "h long, x binary").orderBy("h", "x").limit(limit).collect()  # ids that repeat can't make them more than the bound
    return np.frombuffer(b"".join(r["x"] for r in got), np.float32).reshape(len(got), WIDTH)


def fit_quality(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", fit_rows: int = FIT_ROWS) -> Model:
    """Fits on at most ``fit_rows`` trusted positives and as many documents at large, none of them held out.

    Trusted are rows labelled 1 and never anything else; null ids and labels are left out.  The prior
    is estimated over all documents.  Without positives every score is 0.5.
    """
    need(docs, id_col, text_col)
    need(labels, id_col, label_col)
    src = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).withColumn("h", F.xxhash64("doc_id", "text"))
    known = labels.select(F.col(id_col).alias("doc_id"), F.col(label_col).cast("int").alias("q")).filter(F.col("q").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    good = known.groupBy("doc_id").agg(F.min("q").alias("lo"), F.max("q").alias("hi")).filter("lo = 1 and hi = 1").select("doc_id")
    chosen = good.orderBy(F.xxhash64("doc_id"), "doc_id").limit(fit_rows)
    p = _sample(src.join(F.broadcast(chosen), "doc_id").select("h", "text"), fit_rows)
    nothing = Model(np.zeros(WIDTH), np.ones(WIDTH), np.zeros(WIDTH + 1), 0.5)
    if len(p) < 2:
        return nothing
    open_rows = src.filter(~held_out(F.col("doc_id")))
    least = [r["h"] for r in open_rows.select("h").orderBy("h").limit(fit_rows).collect()]
    if len(least) < 2:
        return nothing
    u = _sample(open_rows.filter(F.col("h") <= least[-1]).select("h", "text"), fit_rows)
    mean, scale = u.mean(axis=0), u.std(axis=0) + 1e-3
    p, u = _centred(p, mean, scale), _centred(u, mean, scale)
    # One half of each sample trains a first model; all documents, and the other half of the positives, show the prior.
    probe = Model(mean, scale, fit_pu(p[::2], u[::2], 0.5, steps=100), 0.5)
    raw = p[1::2] @ probe.weights[:-1] + probe.weights[-1]
    cuts = prior_cuts(raw)
    prior = class_prior(raw, cuts, *_reached(src, probe, cuts))
    return Model(mean, scale, fit_pu(p, u, prior), prior)


def _reached(src: DataFrame, model: Model, cuts: np.ndarray) -> tuple[np.ndarray, int]:
    """How many of all documents have each score at least, and how many there are."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        n, every = np.zeros(len(cuts), np.int64), 0
        for b in batches:
            for _, texts in portions(b, "text"):
                s = np.sort(model.raw(np.stack([features(t) for t in texts]).astype(np.float64)))
                n += len(s) - np.searchsorted(s, cuts, "left")
                every += len(s)
        yield pa.record_batch([pa.array(np.arange(len(cuts) + 1)), pa.array(np.append(n, every))], ["cut", "n"])

    total = dict(src.select("text").mapInArrow(count, "cut long, n long").groupBy("cut").agg(F.sum("n")).collect())
    return np.array([total.get(i, 0) for i in range(len(cuts))], float), total.get(len(cuts), 0)


def score_quality(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD, keep: bool = False) -> DataFrame:
    """One row per row of ``docs``: doc_id, held_out, score, predicted.

    Null texts score as empty ones; rows that repeat score alike; a null id isn't
    held out. With ``keep``, instead the rows of ``docs`` with score at the threshold and above, all their columns as they are.
    """
    need(docs, id_col, text_col)

    def scored(texts: list[str | None]) -> np.ndarray:
        return model.score(np.stack([features(t) for t in texts]).astype(np.float64)) if texts else np.zeros(0)

    if keep:
        at = docs.columns.index(text_col)

        def kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            release()
            for b in batches:
                for part, texts in portions(b, at):
                    yield part.filter(pa.array(scored(texts) >= threshold))

        return docs.mapInArrow(kept, docs.schema)

    src = docs.select(F.col(id_col).alias("doc_id"), held_out(F.col(id_col)).alias("held_out"), F.col(text_col).alias("text"))
    kind = src.schema["doc_id"].dataType.simpleString()

    def rated(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        for b, texts in (x for b in batches for x in portions(b, "text")):
            s = scored(texts)
            yield pa.record_batch([b.column("doc_id"), b.column("held_out"), pa.array(s, pa.float64()), pa.array((s >= threshold).astype(np.int32))], ["doc_id", "held_out", "score", "predicted"])

    return src.mapInArrow(rated, f"doc_id {kind}, held_out boolean, score double, predicted int")
