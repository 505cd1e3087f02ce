"""Nearest neighbours: recall and scores against every distance, odd vectors, bounds."""

import math

import numpy as np
import pytest

from quillon.llm import neighbours
from quillon.llm.registry import op12_nearest_neighbours


def usable(vector):
    return vector is not None and all(x is not None and math.isfinite(x) for x in vector) and any(x != 0 for x in vector)


def brute(rows, every, k=10):
    rows = [(n, i, np.array(v, float)) for n, (i, v) in enumerate(rows) if usable(v)]
    out = []
    for n, i, v in rows:
        if i is not None and i % every == 0:
            others = [(m, j, w) for m, j, w in rows if m != n and len(w) == len(v)]
            apart = sorted((float(np.sqrt(((w - v) ** 2).sum())), j is not None, j or 0) for _, j, w in others)[:k]
            out += [(i, r + 1, j if known else None, s) for r, (s, known, j) in enumerate(apart)]
    return out


def compare(got, want):
    def order(row):
        return row[0], row[1], row[2] is not None, row[2] or 0

    got, want = sorted(map(tuple, got), key=order), sorted(want, key=order)
    assert [r[:3] for r in got] == [r[:3] for r in want]
    assert np.allclose([r[3] for r in got], [r[3] for r in want], rtol=1e-12, atol=0)


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.1"])
def test_recall(spark, sf):
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"/root/testdata/{sf}/embeddings.parquet").collect()]
    got, want = op12_nearest_neighbours(spark, f"/root/testdata/{sf}").collect(), brute(rows, 100)
    found = {(r.query_id, r.vec_id): r.score for r in got}
    hits = [(q, v, s) for q, _, v, s in want if (q, v) in found]
    assert len(got) == len(want) and len(hits) >= 0.99 * len(want)
    assert all(abs(found[q, v] - s) <= 1e-12 * s for q, v, s in hits)


def test_ties_copies_and_odd_vectors(spark):
    rng = np.random.default_rng(1)
    rows = [(k, (rng.integers(-2, 3, 6) * 1.0).tolist()) for k in range(300)]
    rows += [(k % 200, [1.0, 2.0, 3.0, 0.0, -0.0, 1.0]) for k in range(400)]
    rows += [(None, [1.0] * 6), (200, None), (300, [0.0] * 6), (400, [1.0, None, 2.0, 3.0, 4.0, 5.0]), (500, [math.nan] * 6), (600, [math.inf] * 6)]
    rows += [(700, [1.0, 2.0]), (800, [1.0, 3.0]), (900, [5.0] * 3), (1000, [])]
    docs = spark.createDataFrame([(i, v, 1, 2) for i, v in rows], "vec_id long, embedding array<double>, row int, query int")
    compare(neighbours.nearest(docs, 100).collect(), brute(rows, 100))
    assert neighbours.nearest(docs.limit(0), 100).count() == 0


def test_many_runs_and_blocks(spark, monkeypatch):
    monkeypatch.setattr(neighbours, "RUN_ROWS", 50)
    monkeypatch.setattr(neighbours, "QUERY_NUMBERS", 96)
    monkeypatch.setattr(neighbours, "SAMPLE_ROWS", 20)
    monkeypatch.setattr(neighbours, "TILE_CODES", 16)
    rng = np.random.default_rng(2)
    rows = [(k, (rng.standard_normal(16) + 3).tolist()) for k in range(400)]
    compare(neighbours.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), 10, 5).collect(), brute(rows, 10, 5))


def test_bounds_hold_and_prune():
    rng = np.random.default_rng(3)
    vectors = rng.standard_normal((4000, 64)) + 1
    centre = vectors.mean(axis=0)
    codes, length, scalar = neighbours.encode(vectors, centre)
    assert codes.shape == (4000, neighbours.BITS // 8)
    search = neighbours.Search(vectors[:40], centre)
    middle, lower = search.estimates(slice(0, 40), codes, length, scalar)
    apart = ((vectors[:40, None] - vectors[None]) ** 2).sum(axis=2)
    assert np.mean(lower <= apart) > 0.99 and np.corrcoef(middle.ravel(), apart.ravel())[0, 1] > 0.9
    reach = np.sort(apart, axis=1)[:, 10]
    i, j = search.within(codes, length, scalar, reach)
    assert len(i) < 0.1 * 40 * 4000
    assert sum(map((lambda near: near <= set(zip(i.tolist(), j.tolist()))), [{(q, c)} for q in range(40) for c in np.argsort(apart[q])[:11].tolist()])) >= 0.99 * 440
    i, j, value = search.best(codes, length, scalar, 11)
    want = np.sort(middle, axis=1)[:, :11]
    assert np.allclose(np.sort(value.reshape(40, 11), axis=1), want) and np.allclose(middle[i, j], value)
