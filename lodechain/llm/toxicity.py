"""Operator 1: toxicity by a character n-gram linear classifier on naive Bayes log-count ratios.

Features are the distinct character n-grams of the lower-cased text (present or not), hashed to a fixed table. From a
labelled sample each gets the ratio r = log(P(feature | toxic) / P(feature | clean)), smoothed; logistic regression
with an L2 penalty is then fitted on the features scaled by r. Training is the only step that is bounded
(``max_rows`` labelled rows, drawn by a hash of the id); scoring reads every character of every text.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodechain.llm.common import AT_ONCE, append_columns, runs, trimmed

ORDERS = (2, 3, 4, 5)
BITS = 20
#: Code points that are hashed at once.
BLOCK = 1 << 18
_SPACE = re.compile(r"\s+")
_ODD = np.array([(0x9E3779B97F4A7C15 * (2 * i + 1) | 1) & 0xFFFFFFFFFFFFFFFF for i in range(1, 8)], dtype=np.uint64)
_MIX = np.uint64(0xD6E8FEB86659FD93)


def _blocks(text: str):
    """Bucket numbers of all n-grams, block by block and order by order."""
    u = np.frombuffer((" " + _SPACE.sub(" ", text.lower()).strip() + " ").encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.uint64)
    for at in range(0, len(u), BLOCK):
        part = u[at : at + BLOCK + max(ORDERS) - 1]
        h = part * _ODD[0]
        for n in range(2, max(ORDERS) + 1):
            if len(part) < n:
                break
            h = h[:-1] + part[n - 1 :] * _ODD[n - 1]
            if n in ORDERS:
                mixed = (h ^ (h >> np.uint64(29))) * _MIX
                yield ((mixed ^ np.uint64(n)) * _ODD[6] >> np.uint64(64 - BITS)).astype(np.int64)


def features(text: str, among: np.ndarray | None = None) -> np.ndarray:
    """Distinct buckets of a text's n-grams, those only that ``among`` marks."""
    found = [b if among is None else b[among[b]] for b in _blocks(text)]
    return np.unique(np.concatenate(found)) if found else np.empty(0, np.int64)


@dataclass
class Model:
    """Non-zero weights by bucket, and the intercept."""

    buckets: np.ndarray
    weights: np.ndarray
    bias: float

    def tables(self) -> tuple[np.ndarray, np.ndarray]:
        w = np.zeros(1 << BITS)
        w[self.buckets] = self.weights
        return w, w != 0


def _deviation(a: np.ndarray, b: np.ndarray, pos: float, neg: float) -> np.ndarray:
    """Root of the likelihood-ratio statistic of presence against class."""
    total = pos + neg
    g = np.zeros(len(a))
    for seen, size in ((a, pos), (b, neg)):
        for cell, share in ((seen, a + b), (size - seen, total - a - b)):
            with np.errstate(divide="ignore", invalid="ignore"):
                g += np.where(cell > 0, 2 * cell * np.log(cell * total / (share * size)), 0)
    return np.sqrt(np.maximum(g, 0))


def fit(texts: list[str], toxic: list[int], smoothing: float = 1.0, selected: int = 4096, significant: float = 4.0, penalty: float = 1e-6, steps: int = 400) -> Model:
    """Fit on a labelled sample.

    Features whose presence differs between the classes by at least ``significant`` standard deviations (signed root
    of the likelihood-ratio statistic) are kept, the ``selected`` strongest at most. With no rows, or one class only, the model is the smoothed share of toxic rows.
    """
    y = np.asarray(toxic, dtype=np.float64)
    pos = float(y.sum())
    neg = len(y) - pos
    prior = float(np.log((pos + 1) / (neg + 1)))
    if not pos or not neg:
        return Model(np.empty(0, np.int64), np.empty(0), prior)
    rows = [features(t).astype(np.int32) for t in texts]
    a, b = np.zeros(1 << BITS), np.zeros(1 << BITS)
    for r, label in zip(rows, toxic, strict=True):
        (a if label else b)[r] += 1
    ratio = np.log((a + smoothing) / (pos + 2 * smoothing)) - np.log((b + smoothing) / (neg + 2 * smoothing))
    seen = np.flatnonzero(a + b)
    z = np.zeros(1 << BITS)
    z[seen] = _deviation(a[seen], b[seen], pos, neg)
    keep = np.sort(np.argsort(-z, kind="stable")[:selected])
    keep = keep[z[keep] >= significant]
    if not len(keep):
        return Model(np.empty(0, np.int64), np.empty(0), prior)
    column = np.full(1 << BITS, -1, np.int32)
    column[keep] = np.arange(len(keep))
    rows = [c[c >= 0] for c in (column[r] for r in rows)]
    lengths = np.array([len(r) for r in rows])
    cols, owner = np.concatenate(rows), np.repeat(np.arange(len(rows)), lengths)
    r = ratio[keep]
    norm = np.sqrt(max(1.0, float(np.bincount(owner, r[cols] ** 2, len(rows)).mean())))
    value = r[cols] / norm
    w, bias, m, v = np.zeros(len(keep)), prior, np.zeros(len(keep) + 1), np.zeros(len(keep) + 1)
    for t in range(1, steps + 1):  # Adam on the full sample
        p = 1 / (1 + np.exp(-np.clip(np.bincount(owner, value * w[cols], len(rows)) + bias, -40, 40)))
        g = np.append(np.bincount(cols, value * (p - y)[owner], len(keep)) / len(y) + penalty * w, (p - y).mean())
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        step = 0.3 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
        w, bias = w - step[:-1], bias - step[-1]
    return Model(keep, w * r / norm, float(bias))


def training_sample(docs: DataFrame, labels: DataFrame, max_rows: int, doc_id: str = "doc_id", text: str = "text", label: str = "toxic") -> DataFrame:
    """(h, k, t, y): at most ``max_rows`` labelled rows' texts, those with the smallest hashes of their id; of rows that
    share an id, too, no more. Rows without a label, id or text take no part."""
    order = ("h", "k", "y")
    chosen = labels.select(F.col(doc_id).alias("k"), F.col(label).cast("int").alias("y")).where("k is not null and y is not null").withColumn("h", F.xxhash64("k")).orderBy(*order).limit(max_rows)
    found = docs.select(F.col(doc_id).alias("k"), F.col(text).alias("t")).where("t is not null").join(F.broadcast(chosen.distinct()), "k")
    return found.orderBy(*order, F.xxhash64("t")).limit(max_rows).select("h", "k", "t", "y")


def train(sample: DataFrame, max_bytes: int = 256 << 20) -> Model:
    """``fit`` on a bounded sample, in one task, so that the driver holds the model only. Whole texts are taken in order
    of their ids' hashes until the next would exceed ``max_bytes`` in all."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        texts, toxic, size = [], [], 0
        for b in batches:
            for lo, hi in runs(b.column(0), AT_ONCE):
                for t, y in zip(b.column(0)[lo:hi].to_pylist(), b.column(1)[lo:hi].to_pylist(), strict=True):
                    size += len(t.encode("utf-8", "surrogatepass"))
                    if size <= max_bytes:
                        texts.append(t)
                        toxic.append(int(y != 0))
        m = fit(texts, toxic)
        yield pa.RecordBatch.from_arrays([pa.array([m.buckets.astype(np.int64).tobytes()]), pa.array([m.weights.astype(np.float64).tobytes()]), pa.array([m.bias])], names=["buckets", "weights", "bias"])

    ordered = sample.repartition(1).sortWithinPartitions("h", "k", "y", F.sha2("t", 256)).select("t", "y")
    found = ordered.mapInArrow(trimmed(run), "buckets binary, weights binary, bias double").collect()
    if not found:
        return fit([], [])
    return Model(np.frombuffer(found[0].buckets, np.int64), np.frombuffer(found[0].weights, np.float64), found[0].bias)


def score(df: DataFrame, model: Model, text: str = "text", out: str = "score") -> DataFrame:
    """``df`` with the probability that each whole text is toxic; null and empty texts get that of no feature. Narrow.
    The model (at most ``selected`` weights) is broadcast."""
    shared = df.sparkSession.sparkContext.broadcast(model)
    ready: list = []

    def run(b):
        if not ready:
            ready.extend(shared.value.tables())
        w, nonzero = ready
        logit = np.array([w[features(t or "", nonzero)].sum() for t in b[text].to_pylist()]) + shared.value.bias
        return [1 / (1 + np.exp(-np.clip(logit, -40, 40)))]

    return append_columns(df, run, [T.StructField(out, T.DoubleType())], [text])


def classify(docs: DataFrame, labels: DataFrame, max_rows: int = 6000, doc_id: str = "doc_id", text: str = "text", label: str = "toxic", threshold: float = 0.5) -> DataFrame:
    """``docs`` with ``held_out``, ``score`` and ``predicted``.

    Labels are learnt only from rows whose crc32 of the id (as text) modulo 5 is not 0; the others are ``held_out``. A
    row without an id is not held out. Repeated rows are scored alike, each once. Null and empty texts get the score of
    no feature; texts are read whole, in blocks. An empty table gives an empty result; without usable labels every score
    is 1/2. Columns named like the outputs are replaced, others stay. The sample is bounded by ``max_rows`` and by
    ``max_bytes`` of ``train``; that features must pass a significance test is part of the model.
    """
    fold = F.crc32(F.col(doc_id).cast("string")) % 5
    model = train(training_sample(docs, labels.where(fold != 0), max_rows, doc_id, text, label))
    scored = score(docs, model, text)
    return scored.withColumn("held_out", F.coalesce(fold == 0, F.lit(False))).withColumn("predicted", (F.col("score") >= threshold).cast("int"))
