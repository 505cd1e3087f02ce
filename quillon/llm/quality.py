"""Quality classifier: Bradley-Terry pairwise ranking of texts.

Each pair of a good and a bad labelled text is a preference; the probability that
one is preferred is the logistic function of the difference of their scores, and
a score is linear in the text's features. The threshold is the score at the
quantile that the share of bad labels names, and scores are mapped to 0 to 1 so
that it falls on ``THRESHOLD``.

What matters is learned from the texts: the features are hashed runs of three
bytes and of four character shapes (small letter, capital, digit, or the mark
itself) of the whole text, beside a few statistics of length and repetition. Ids,
sources and language are never read. Fitting uses at most ``FIT_ROWS`` labelled
texts of the learning fold.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.llm.learning import bounded, bounded_batches, by_place, fit_pairs, gram_counts, held_out, pack_row, sigmoid, unpack_rows

THRESHOLD = 0.7
FIT_ROWS = 8_000
PAIRS = 60_000
RIDGE = 1e-5
BATCH_DOCS = 250
GRAM_BITS, SHAPE_BITS = 11, 9
STATISTICS = ["log bytes", "mean word", "distinct words", "doubled words", "top word", "distinct lines", "words a line", "packed size"]
STATISTIC_WEIGHT = 0.25
WIDTH = (1 << GRAM_BITS) + (1 << SHAPE_BITS) + len(STATISTICS)

# Shapes: "a" for small letters and bytes beyond ASCII, "A" for capitals, "0" for digits.
_SHAPE = np.arange(256, dtype=np.uint8)
_SHAPE[97:123] = _SHAPE[128:] = 97
_SHAPE[65:91], _SHAPE[48:58] = 65, 48


def _unit(counts: np.ndarray) -> np.ndarray:
    x = np.sqrt(counts.astype(np.float32))
    return x / (np.linalg.norm(x) or 1.0)


def statistics(data: bytes) -> list[float]:
    """The values that ``STATISTICS`` names."""
    words, lines = data.split(), data.split(b"\n")
    k = max(1, len(words))
    rows = np.fromiter(map(hash, words), np.int64, len(words))
    counts = np.unique(rows, return_counts=True)[1] if words else np.ones(1)
    return [
        np.log1p(len(data)), sum(map(len, words)) / k, np.log1p(len(counts)) / np.log1p(k), (rows[1:] == rows[:-1]).sum() / k, counts.max() / k,
        len(set(lines)) / len(lines), np.log1p(k / len(lines)), min(2.0, len(zlib.compress(data, 1)) / len(data)),
    ]


def features(text: str | None) -> np.ndarray:
    """``WIDTH`` values; zeros for a null or empty text."""
    data = (text or "").encode("utf-8", "surrogatepass")
    if not data:
        return np.zeros(WIDTH, np.float32)
    raw = np.frombuffer(b" " + data + b" ", np.uint8)
    parts = _unit(gram_counts(raw, 3, GRAM_BITS)), _unit(gram_counts(_SHAPE[raw], 4, SHAPE_BITS)), statistics(data)
    return np.concatenate(parts).astype(np.float32)


@dataclass(frozen=True)
class QualityModel:
    """``mean`` and ``scale`` are those of the statistics."""

    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    cut: float
    sharpness: float

    def latent(self, x: np.ndarray) -> np.ndarray:
        return _scaled(x, self.mean, self.scale) @ self.weights

    def score(self, x: np.ndarray) -> np.ndarray:
        """0 to 1; the quantile threshold maps to ``THRESHOLD``."""
        return sigmoid(self.sharpness * (self.latent(x) - self.cut) + np.log(THRESHOLD / (1 - THRESHOLD)))


def _scaled(x: np.ndarray, mean: np.ndarray, scale: np.ndarray) -> np.ndarray:
    z, n = x.copy(), len(STATISTICS)
    z[:, -n:] = STATISTIC_WEIGHT * np.clip((x[:, -n:] - mean) / scale, -4, 4)
    return z


def fit(x: np.ndarray, y: np.ndarray, pairs: int = PAIRS) -> QualityModel:
    """Model from features and labels of 1 (good) and 0; one class alone is all kept."""
    x, y, n = np.asarray(x, np.float32).reshape(-1, WIDTH), np.asarray(y, int), len(STATISTICS)
    mean, scale = (x[:, -n:].mean(0), x[:, -n:].std(0) + 1e-6) if len(x) else (np.zeros(n), np.ones(n))
    good, bad = np.flatnonzero(y == 1), np.flatnonzero(y == 0)
    if not len(good) or not len(bad):
        return QualityModel(mean, scale, np.zeros(WIDTH), -1.0 if len(good) or not len(bad) else 1.0, 1.0)
    z, rng = _scaled(x, mean, scale), np.random.default_rng(0)
    n_pairs = max(pairs, len(good), len(bad))
    better = np.resize(rng.permutation(good), n_pairs)
    worse = np.resize(rng.permutation(bad), n_pairs)[rng.permutation(n_pairs)]
    weights = fit_pairs(z, better, worse, RIDGE)
    ranked = np.sort(z @ weights)
    cut = float(ranked[len(bad) - 1 : len(bad) + 1].mean())
    return QualityModel(mean, scale, weights, cut, 2.0 / float(ranked.std() + 1e-9))


def featurize(batches, text: str = "text"):
    """Small Arrow batches, each with the feature matrix of its texts."""
    for whole in batches:
        for at in range(0, whole.num_rows, BATCH_DOCS):
            batch = whole.slice(at, BATCH_DOCS)
            yield batch, np.array([features(t) for t in batch.column(text).to_pylist()], np.float32).reshape(-1, WIDTH)


def train(docs: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS) -> QualityModel:
    """Fit on a bounded sample of labelled documents outside the held-out fold.

    One text for each chosen ``doc_id``, so ``fit_rows`` bounds what the driver
    gets (about 6 bytes for each feature that a text has).
    """
    known = labels.filter("doc_id IS NOT NULL AND quality IN (0, 1)").filter(~held_out(F.col("doc_id")))
    chosen = bounded(known.groupBy("doc_id").agg(F.min("quality").cast("int").alias("quality")), fit_rows, "doc_id")
    texts = docs.select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).join(F.broadcast(chosen), "doc_id")
    rows = texts.groupBy("doc_id", "quality").agg(F.min_by("text", F.xxhash64("text")).alias("text"))

    def run(batches):
        for batch, x in featurize(batches):
            yield pa.RecordBatch.from_arrays([batch.column("quality"), pa.array(list(map(pack_row, x)), pa.binary())], ["quality", "x"])

    got = sorted((r.quality, bytes(r.x)) for r in rows.mapInArrow(run, "quality int, x binary").collect())
    return fit(unpack_rows([x for _, x in got], WIDTH), np.array([q for q, _ in got], int))


def score_documents(docs: DataFrame, model: QualityModel) -> DataFrame:
    """``doc_id, held_out, score, predicted`` for every row."""

    def run(batches):
        for batch, x in featurize(batches):
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(model.score(x), pa.float64())], ["doc_id", "score"])

    sent = bounded_batches(docs).select("doc_id", F.col("text").cast("string"))
    scored = sent.mapInArrow(run, f"doc_id {sent.schema['doc_id'].dataType.simpleString()}, score double")
    predicted = F.when(F.col("score") >= THRESHOLD, 1).otherwise(0)
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", predicted.alias("predicted"))


def classify(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Learn and score every row's whole text.

    Null and empty texts get a score too, null ids are not held out and not
    learned from, repeated rows get the same score each, and of repeated labels of
    an id the lower counts. Without labels of both classes all are kept (all
    rejected where only bad ones exist). An empty table gives no rows; columns
    with other names are not read.
    """
    return score_documents(docs, train(docs, labels))


def filter_quality(docs: DataFrame, model: QualityModel) -> DataFrame:
    """The rows of ``docs``, all columns, whose texts reach the threshold.

    Each row is judged by its own text, whatever its ``doc_id`` and other columns.
    """
    renamed, text = by_place(docs)
    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in renamed.schema)

    def run(batches):
        for batch, x in featurize(batches, text):
            yield batch.filter(pa.array(model.score(x) >= THRESHOLD, pa.bool_()))

    return renamed.mapInArrow(run, kinds).select(*[f"c{i}" for i in range(len(docs.columns))]).toDF(*docs.columns)
