"""Sparse logistic regression on hashed features, trained with follow-the-regularised-leader updates.

Training reads a bounded sample (`labelled_sample`: at most `limit` rows, picked by a hash of
the key, so it is the same on every run), makes features in parallel and runs the sequential
updates in one task. The model is 2**BITS floats, whatever the size of the data.
"""
from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BITS = 18
M1, M2, M3 = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9))


def slots(hashes: np.ndarray, stream: int) -> np.ndarray:
    """Model slots of 64-bit hashes; streams of features get different ones for the same hash."""
    x = (hashes + np.uint64(stream)) * M1
    return ((x ^ (x >> np.uint64(29))) * M2) >> np.uint64(64 - BITS)


def labelled_sample(labels: DataFrame, label: str, learn: Column, limit: int, key: str = "doc_id") -> DataFrame:
    """(key, label) of at most `limit` rows of `labels` for which `learn` holds: those of least key hash. Repeated keys count once, null keys or labels never."""
    rows = labels.where(learn & F.col(key).isNotNull() & F.col(label).isNotNull()).groupBy(key).agg(F.max(label).cast("int").alias("label"))
    return rows.orderBy(F.xxhash64(key), key).limit(limit)


def calibration(margins: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and shift of the logistic curve that fits labels to margins best, by Newton steps; 1 and 0 if only one label occurs."""
    at = np.asarray([1.0, 0.0])
    if 0 < y.sum() < len(y):
        x = np.stack([margins, np.ones(len(margins))])
        for _ in range(50):
            p = 1 / (1 + np.exp(-np.clip(at @ x, -35, 35)))
            step = np.linalg.solve((x * p * (1 - p)) @ x.T + 1e-6 * np.eye(2), x @ (p - y))
            at = at - step
            if np.abs(step).max() < 1e-9:
                break
    return (float(at[0]), float(at[1])) if at[0] > 0 and np.isfinite(at).all() else (1.0, 0.0)


def fit(docs: DataFrame, sample: DataFrame, features, epochs: int = 4, alpha: float = 0.5, beta: float = 0.1, l1: float = 0.02, l2: float = 0.0, calibrate: bool = False, key: str = "doc_id", text: str = "text") -> np.ndarray:
    """Weights, the bias last. `features` makes a callable text -> (slots, values); an empty sample gives zero weights, so every score is 0.5.

    With `calibrate`, each half of the sample is scored by weights learned from the other half, and
    the final weights and bias are scaled by the logistic curve that fits those scores.
    """

    def made(texts: pa.Array) -> pa.Array:
        of = features()
        return pa.array([a.astype("<i4").tobytes() + b.astype("<f4").tobytes() for a, b in (of(t or "") for t in texts.to_pylist())], pa.binary())

    def updated(rows: list) -> np.ndarray:
        z, n = np.zeros(2**BITS + 1), np.zeros(2**BITS + 1)

        def weights(i):
            zi = z[i]
            return np.where(np.abs(zi) <= l1, 0.0, -(zi - np.sign(zi) * l1) / ((beta + np.sqrt(n[i])) / alpha + l2))

        for _ in range(epochs):
            for y, i, x in rows:
                w = weights(i)
                g = (1 / (1 + np.exp(-np.clip(w @ x, -35, 35))) - y) * x
                sigma = (np.sqrt(n[i] + g * g) - np.sqrt(n[i])) / alpha
                z[i] += g - sigma * w
                n[i] += g * g
        return weights(np.arange(2**BITS + 1))

    def updates(batches):
        rows = sorted((k, y, x) for b in batches for k, y, x in zip(*(b.column(c).to_pylist() for c in ("k", "label", "x"))))
        rows = [(y, np.append(np.frombuffer(x[: len(x) // 2], "<i4"), 2**BITS), np.append(np.frombuffer(x[len(x) // 2 :], "<f4"), 1.0)) for _, y, x in rows]
        w = updated(rows)
        if calibrate and len(rows) > 1:
            margins = np.zeros(len(rows))
            for half in (0, 1):
                other = updated(rows[1 - half :: 2])
                margins[half::2] = [other[i] @ x for _, i, x in rows[half::2]]
            slope, shift = calibration(margins, np.asarray([y for y, _, _ in rows], float))
            w = slope * w
            w[-1] += shift
        yield pa.RecordBatch.from_arrays([pa.array([w.astype("<f4").tobytes()], pa.binary())], ["w"])

    # At most the sample's limit of rows, whatever the tables' size. Of texts that share a key the least counts.
    chosen = docs.select(key, text).join(F.broadcast(sample), key).groupBy(key, "label").agg(F.min(text).alias(text))
    rows = chosen.select(F.xxhash64(key).alias("k"), "label", F.arrow_udf(made, "binary")(F.coalesce(text, F.lit(""))).alias("x"))
    got = rows.repartition(1).mapInArrow(updates, "w binary").collect()
    return np.frombuffer(bytes(got[0].w), "<f4").astype(float) if got else np.zeros(2**BITS + 1)


def score(docs: DataFrame, weights: np.ndarray, features, text: str = "text", into: str = "score") -> DataFrame:
    """`docs` with double `into`: the sigmoid of each whole text's sparse dot product; null texts count as empty."""
    w = weights.astype("<f4")

    def scored(texts: pa.Array) -> pa.Array:
        of = features()
        dots = np.asarray([float(w[i] @ x) for i, x in (of(t) for t in texts.to_pylist())]) + float(w[-1])
        return pa.array(1 / (1 + np.exp(-np.clip(dots, -35, 35))), pa.float64())

    return docs.withColumn(into, F.arrow_udf(scored, "double")(F.coalesce(text, F.lit(""))))
