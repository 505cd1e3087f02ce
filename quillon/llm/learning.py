"""What the two classifiers share: the held-out fold and linear training."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillon.plans.staging import bounded_batches

HELD_OUT_MOD, HELD_OUT = 4, 2
CHUNK_BYTES = 1 << 20


def held_out(doc_id: Column) -> Column:
    """True for the fold that is never learned from; false for a null id."""
    fold = F.crc32(doc_id.cast("string").cast("binary")) % HELD_OUT_MOD
    return F.coalesce(fold == HELD_OUT, F.lit(False))


def bounded(rows: DataFrame, limit: int, *by: str) -> DataFrame:
    """At most ``limit`` rows, the same ones at every run, spread by hash."""
    return rows.withColumn("_h", F.xxhash64(*by)).orderBy("_h", *by).limit(limit).drop("_h")


def by_place(docs: DataFrame) -> tuple[DataFrame, str]:
    """``docs`` with columns named by place, so that none can clash, and the name of the text.

    A text that is no string gets a string beside it; else the one column serves
    for reading and for keeping, so that texts are sent once.
    """
    renamed, text = bounded_batches(docs).toDF(*[f"c{i}" for i in range(len(docs.columns))]), f"c{docs.columns.index('text')}"
    if renamed.schema[text].dataType.simpleString() == "string":
        return renamed, text
    return renamed.withColumn("text", F.col(text).cast("string")), "text"


def fit_linear(x: np.ndarray, y: np.ndarray, weight: np.ndarray, loss: str, ridge: float, steps: int = 300) -> np.ndarray:
    """Weights of a linear model without intercept for labels of -1 and 1.

    ``logistic`` or squared ``hinge`` loss plus a ridge term, by Nesterov's
    accelerated gradient with a step from the data's largest singular value.
    """
    kind = x.dtype
    w = seen = np.zeros(x.shape[1], kind)
    y, weight = y.astype(kind), (weight / weight.sum()).astype(kind)
    v = np.random.default_rng(0).standard_normal(x.shape[1]).astype(kind)
    for _ in range(30):
        v = x.T @ (weight * (x @ v))
        v /= np.linalg.norm(v) or 1.0
    curve = float(v @ (x.T @ (weight * (x @ v))))
    rate = 1.0 / ((0.25 if loss == "logistic" else 2.0) * 1.05 * curve + ridge)
    for k in range(steps):
        at = w + kind.type(k / (k + 3)) * (w - seen)
        margin = y * (x @ at)
        slope = -1.0 / (1.0 + np.exp(np.clip(margin, -50, 50))) if loss == "logistic" else -2.0 * np.maximum(0.0, 1.0 - margin)
        seen, w = w, (at - rate * (x.T @ (weight * y * slope) + ridge * at)).astype(kind)
    return w


def fit_pairs(x: np.ndarray, better: np.ndarray, worse: np.ndarray, ridge: float, steps: int = 150) -> np.ndarray:
    """Bradley-Terry weights: logistic loss on ``x[better] - x[worse]`` of row pairs.

    The differences are never stored: a step needs a score for each row and the
    sum of its pairs' slopes. Nesterov's accelerated gradient, as in ``fit_linear``.
    """
    kind, rows, pairs = x.dtype, len(x), len(better)

    def pull(slope: np.ndarray) -> np.ndarray:
        by_row = np.bincount(better, slope, rows) - np.bincount(worse, slope, rows)
        return x.T @ (by_row / pairs).astype(kind)

    def apart(w: np.ndarray) -> np.ndarray:
        score = x @ w
        return score[better] - score[worse]

    v = np.random.default_rng(0).standard_normal(x.shape[1]).astype(kind)
    for _ in range(20):
        v = pull(apart(v))
        v /= np.linalg.norm(v) or 1.0
    rate = 1.0 / (0.25 * 1.05 * float(v @ pull(apart(v))) + ridge)
    w = seen = np.zeros(x.shape[1], kind)
    for k in range(steps):
        at = w + kind.type(k / (k + 3)) * (w - seen)
        slope = -1.0 / (1.0 + np.exp(np.clip(apart(at), -50, 50)))
        seen, w = w, (at - rate * (pull(slope) + ridge * at)).astype(kind)
    return w


def gram_counts(data: np.ndarray, width: int, bits: int) -> np.ndarray:
    """Counts of the runs of ``width`` bytes, hashed into ``2 ** bits`` slots."""
    out = np.zeros(1 << bits, np.int64)
    for at in range(0, len(data) - width + 1, CHUNK_BYTES):
        part = data[at : at + CHUNK_BYTES + width - 1].astype(np.uint32)
        grams = part[: len(part) - width + 1].copy()
        for k in range(1, width):
            grams |= part[k : len(part) - width + 1 + k] << np.uint32(8 * k)
        out += np.bincount((grams * np.uint32(0x9E3779B1)) >> np.uint32(32 - bits), minlength=1 << bits)
    return out


def pack_row(x: np.ndarray) -> bytes:
    """A sparse row of fewer than 65,536 columns as places and 32-bit values."""
    at = np.flatnonzero(x)
    return at.astype("<u2").tobytes() + x[at].astype("<f4").tobytes()


def unpack_rows(rows: list[bytes], columns: int) -> np.ndarray:
    out = np.zeros((len(rows), columns), np.float32)
    for k, row in enumerate(rows):
        n = len(row) // 6
        out[k, np.frombuffer(row, "<u2", n)] = np.frombuffer(row, "<f4", n, 2 * n)
    return out


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(z, -40, 40)))
