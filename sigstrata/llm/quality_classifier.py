"""Quality classifier: naive Bayes support vectors.

Features are indicators of token unigrams and bigrams, hashed into BUCKETS; tokens are runs of word
characters or of other visible ones, and a pair of equal tokens is a feature of its own. Indicators are
scaled by the log ratio of their smoothed class counts, and a linear model with hinge loss is fitted by
dual coordinate descent. A logistic curve fitted to rows left out of the descent turns margins into scores.

The model is fitted on at most FIT_ROWS labelled documents of at most FIT_VALUES features in all, taken in the order
of a hash of doc_id, among those whose crc32(doc_id as text) mod 4 is not 2 (of several texts under one id, that of
the smallest hash); everything else reads all rows. Only texts are inputs of a
score. A doc_id whose labels contradict each other, or are null, is not learned from. Null and empty texts
have no features: their score is that of the bias. Without any labelled rows of both classes the score is 0.5.
Repeated rows are scored each; empty tables give empty results.
"""

from __future__ import annotations

import re

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sigstrata.llm.common import Cache, discard, map_texts, materialize

BUCKETS = 1 << 18
FIT_ROWS = 6_000
FIT_VALUES = 16_000_000
TOKEN = re.compile(r"\w+|[^\w\s]+")
CUT = 0.7
C = 0.1
_hashes = Cache()


def features(text: str | None) -> np.ndarray:
    """Sorted distinct buckets of a text's n-grams."""
    from zlib import crc32

    tokens = TOKEN.findall(text or "")
    if not tokens:
        return np.zeros(0, dtype=np.int64)
    _hashes.room()
    short, long = _hashes.split(set(tokens))
    for t in short:
        _hashes.keep(t, crc32(t.encode()))
    here = {t: crc32(t.encode()) for t in long}
    h = np.array([_hashes[t] if t in _hashes else here[t] for t in tokens], dtype=np.uint64)
    pair = np.where(h[1:] == h[:-1], np.uint64(0x5BD1E995), h[:-1] * np.uint64(0x9E3779B97F4A7C15) + h[1:] * np.uint64(0xC2B2AE3D27D4EB4F))
    both = np.concatenate([h * np.uint64(0xFF51AFD7ED558CCD), pair]) >> np.uint64(64 - 18)
    return np.unique(both.astype(np.int64))


class Model:
    def __init__(self, weights: np.ndarray, bias: float, slope: float, shift: float):
        self.weights, self.bias, self.slope, self.shift = weights.astype(np.float32), bias, slope, shift

    def margin(self, f: np.ndarray) -> float:
        return float(self.weights[f].sum(dtype=np.float64)) / max(1.0, len(f)) ** 0.5 + self.bias

    def score(self, text: str | None) -> float:
        z = self.slope * self.margin(features(text)) + self.shift
        return float(1 / (1 + np.exp(-np.clip(z, -60, 60))))


def descend(rows: list[np.ndarray], y: np.ndarray, r: np.ndarray, cost: np.ndarray, epochs: int = 20, seed: int = 7) -> tuple[np.ndarray, float]:
    """Dual coordinate descent for L1-loss SVM with row costs; rows are scaled by r and to unit-like length."""
    w, bias = np.zeros(len(r)), 0.0
    alpha = np.zeros(len(rows))
    scaled = [r[f] / max(1.0, len(f)) ** 0.5 for f in rows]
    q = np.array([x @ x + 1.0 for x in scaled])
    rng = np.random.default_rng(seed)
    for _ in range(epochs):
        most = 0.0
        for i in rng.permutation(len(rows)):
            f, x = rows[i], scaled[i]
            g = y[i] * (w[f] @ x + bias) - 1
            new = min(max(alpha[i] - g / q[i], 0.0), cost[i])
            step = (new - alpha[i]) * y[i]
            if step:
                w[f] += step * x
                bias += step
                most = max(most, abs(step))
                alpha[i] = new
        if most < 1e-4:
            break
    return w, bias


def fit(rows: list[np.ndarray], quality: np.ndarray) -> Model:
    """Fit on rows (feature buckets) and their 0/1 labels."""
    if len(set(quality.tolist())) < 2:
        return Model(np.zeros(BUCKETS), 0.0, 0.0, 0.0)
    y = np.where(quality == 1, 1.0, -1.0)
    check = np.arange(len(rows)) % 5 == 0
    if len(set(y[~check].tolist())) < 2 or len(set(y[check].tolist())) < 2:
        check[:] = False
    train = np.flatnonzero(~check)
    counts = np.ones((2, BUCKETS))
    for i in train:
        counts[int(y[i] > 0)][rows[i]] += 1
    r = np.log(counts[1] / counts[1].sum()) - np.log(counts[0] / counts[0].sum())
    share = np.array([(y[train] < 0).mean(), (y[train] > 0).mean()])
    cost = C / (2 * share[(y[train] > 0).astype(int)]) * 10
    w, bias = descend([rows[i] for i in train], y[train], r, cost)
    model = Model(w * r, bias, 1.0, 0.0)
    held = np.flatnonzero(check) if check.any() else train
    z = np.array([model.margin(rows[i]) for i in held])
    model.slope, model.shift = calibrate(z, y[held] > 0)
    return model


def calibrate(z: np.ndarray, good: np.ndarray) -> tuple[float, float]:
    """Slope and shift of a logistic curve, with Platt's smoothed targets, by Newton steps."""
    n1, n0 = good.sum(), (~good).sum()
    t = np.where(good, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    a, b = 1.0, 0.0
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(a * z + b, -60, 60)))
        g = np.array([((p - t) * z).sum(), (p - t).sum()])
        v = np.maximum(p * (1 - p), 1e-9)
        h = np.array([[(v * z * z).sum() + 1e-3, (v * z).sum()], [(v * z).sum(), v.sum() + 1e-3]])
        step = np.clip(np.linalg.solve(h, g), -1, 1)
        a, b = a - step[0], b - step[1]
        if np.abs(step).max() < 1e-8:
            break
    return max(a, 1e-3), b


def held_out(doc_id: str = "doc_id"):
    return F.coalesce(F.pmod(F.crc32(F.col(doc_id).cast("string").cast("binary")), F.lit(4)) == 2, F.lit(False))


def training_rows(docs: DataFrame, labels: DataFrame, rows: int = FIT_ROWS) -> tuple[list[np.ndarray], np.ndarray]:
    """Features and labels of the bounded sample. Labels of the sample (at most `rows`) are broadcast."""
    sample = (
        labels.where("doc_id is not null and quality is not null").where(~held_out())
        .groupBy("doc_id").agg(F.min("quality").alias("quality"), F.max("quality").alias("__high")).where("quality = __high")
        .orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows).select(F.col("doc_id").alias("__id"), F.col("quality").alias("__quality"))
    )
    known = docs.select("doc_id", "text").join(F.broadcast(sample), F.col("doc_id") == F.col("__id"))
    # one text an id, by a partial aggregation, before anything is gathered
    known = known.groupBy(F.col("__id").alias("id"), F.col("__quality").alias("quality")).agg(F.min(F.struct(F.xxhash64("text").alias("h"), "text")).alias("t"))
    field = [T.StructField("f", T.ArrayType(T.IntegerType()))]
    made = map_texts(known.select("id", "quality", F.col("t.text").alias("text")), lambda texts: [[features(t).tolist() for t in texts]], field, keep=["id", "quality"])
    made = materialize(made.withColumn("values", F.size("f")))
    held, ids = 0, []
    for r in made.orderBy(F.xxhash64("id"), "id").select("id", "values").collect():  # at most `rows` rows
        held += r["values"]
        if held > FIT_VALUES:
            break
        ids.append(r.id)
    if not ids:
        discard(made)
        return [], np.zeros(0, dtype=np.int64)
    got = made.join(F.broadcast(made.sparkSession.createDataFrame([(i,) for i in ids], "id long")), "id").select("id", "quality", "f").toArrow()
    discard(made)
    order = np.argsort(got["id"].to_numpy())[np.random.default_rng(11).permutation(len(ids))]
    lists = got["f"].combine_chunks()
    flat, cuts = lists.values.to_numpy(), lists.offsets.to_numpy()
    return [flat[cuts[i] : cuts[i + 1]].astype(np.int64) for i in order], got["quality"].to_numpy()[order]


def score_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    model = docs.sparkSession.sparkContext.broadcast(fit(*training_rows(docs, labels)))  # BUCKETS floats

    def scores(texts: list) -> list:
        return [[model.value.score(t) for t in texts]]

    scored = map_texts(docs.select("doc_id", "text"), scores, [T.StructField("score", T.DoubleType())], keep=["doc_id"])
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= CUT).cast("int").alias("predicted"))
