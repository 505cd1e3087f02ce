"""Retrieval against exact BM25 scores; matches against all pairs."""

import math
import random
from collections import Counter

import numpy as np
import pytest

from quillon.llm import decontamination as dc
from quillon.llm.registry import op5_benchmark_decontamination


def test_search_equals_scoring_all_items():
    rng = random.Random(1)
    vocab = [f"w{k}" for k in range(60)]
    items = [dc.Item(k, rng.choices(vocab, [1 / (j + 1) for j in range(60)], k=rng.randint(3, 20)), [], False) for k in range(70)]
    df, n_words = Counter(w for i in items for w in set(i.words)), sum(len(i.words) for i in items)
    index = dc.Index(items, 70, n_words / 70, df, 20)
    dense = np.zeros((70, len(index.vocabulary)))
    for k, item in enumerate(items):
        for w, c in Counter(item.words).items():
            idf = math.log(1 + (70 - df[w] + 0.5) / (df[w] + 0.5))
            dense[k, index.vocabulary[w]] = idf * c * 2.2 / (c + 1.2 * (0.25 + 0.75 * len(item.words) / (n_words / 70)))
    dense /= dense.sum(1, keepdims=True)
    sets = [np.unique(rng.choices(range(len(index.vocabulary)), k=rng.randint(0, 25))).astype(np.int64) for _ in range(200)]
    query, term = np.repeat(np.arange(200), list(map(len, sets))), np.concatenate(sets)
    for threshold in (0.2, 0.5):
        q, k, score = index.search(query, term, threshold)
        want = {(n, int(i)) for n, terms in enumerate(sets) for i in np.flatnonzero(dense[:, terms].sum(1) >= threshold)}
        assert set(zip(q.tolist(), k.tolist(), strict=True)) == want and len(want) > 50
        assert np.allclose(score, [dense[i, sets[n]].sum() for n, i in zip(q, k, strict=True)])


def test_block_sizes_change_nothing(spark, monkeypatch):
    words = [f"a{k}" for k in range(90)]
    loose = " ".join(w if k % 30 else f"{w} {' '.join(f'z{j}' for j in range(20))}" for k, w in enumerate(words[:60]))
    benchmark = spark.createDataFrame([(1, " ".join(words)), (2, " ".join(words[:60])), (3, "b c d")], "item_id long, text string")
    docs = spark.createDataFrame([(1, loose), (2, " ".join(words)), (3, "a b c d e")], "doc_id long, text string")
    got = []
    for size in (20_000, 1):
        monkeypatch.setattr(dc, "BLOCK_ITEMS", size)
        got.append(sorted((r.doc_id, r.item_id) for r in dc.contaminated(docs, benchmark).collect()))
    assert got[0] == got[1] and {(2, 1), (2, 2), (3, 3)} <= set(got[0])


def brute(docs, items):
    found = set()
    for doc, text in docs:
        own = dc.shingles(dc.words_of(text))
        for item, words in items:
            if (s := dc.shingles(dc.words_of(words))) and len(s & own) / len(s) >= 0.8:
                found.add((doc, item))
    return found


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_query(spark, sf):
    base = f"/root/testdata/{sf}"
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{base}/documents.parquet").collect()]
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{base}/benchmark.parquet").collect()]
    got = {(r.doc_id, r.item_id) for r in op5_benchmark_decontamination(spark, base).collect()}
    assert got == brute(docs, items) and got


def test_blocks_answers_and_edges(spark, monkeypatch):
    monkeypatch.setattr(dc, "BLOCK_ITEMS", 2)
    words = [f"q{k}" for k in range(30)]
    items = [(k, " ".join(f"{w}x{k}" for w in words), f"the answer of {k} is {k * 7} indeed") for k in range(5)]
    benchmark = spark.createDataFrame([*items, (None, "a b", "c"), (9, None, None), (4, items[4][1], items[4][2])], "item_id long, text string, answer string")
    filler = " ".join(f"f{k}" for k in range(200))
    docs = [(k, f"{filler} {q} {a} {filler}", k, "x") for k, q, a in items]
    docs += [(10, items[0][1], 1, "x"), (None, None, None, None), (11, "", 1, ""), (None, f"{items[1][1].upper()}, {items[1][2]}", 0, ""), (12, filler * 3000, 0, "")]
    df = spark.createDataFrame(docs + docs[:1], "doc_id long, text string, item_id int, held_id string")
    got = {(r.doc_id, r.item_id) for r in dc.contaminated(df, benchmark).collect()}
    assert got == {(k, k) for k in range(5)} | {(None, 1)}
    kept = dc.clean_documents(df, benchmark)
    assert kept.columns == df.columns and sorted(r.doc_id or 0 for r in kept.collect()) == [0, 10, 11, 12]
    assert dc.contaminated(df, benchmark.limit(0)).count() == 0 and dc.contaminated(df.limit(0), benchmark).count() == 0


def test_clean_rows_stay_beside_leaks_of_their_id(spark, monkeypatch):
    leak, other, filler = (" ".join(f"{p}{k}" for k in range(30)) for p in ("q", "r", "f"))
    benchmark = spark.createDataFrame([(1, leak), (2, other)], "item_id long, text string")
    rows = [(None, f"{filler} {leak}", "text"), (None, filler, "a"), (None, None, None), (7, f"{other} {filler}", "b"), (7, filler, "c"), (7, filler, "c"), (8, "", "d")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, c1 string")
    for size in (20_000, 1):
        monkeypatch.setattr(dc, "BLOCK_ITEMS", size)
        kept = dc.clean_documents(docs, benchmark)
        assert kept.columns == docs.columns
        assert sorted(map(str, map(tuple, kept.collect()))) == sorted(map(str, [r for r in rows if leak not in (r[1] or "") and other not in (r[1] or "")]))
