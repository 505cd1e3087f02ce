"""Sketches against exact shingle sets; the edited-text query against a loop."""

import base64
import hashlib
import random
import re

import numpy as np
import xxhash

from quillon.llm import sketches as sk
from quillon.llm.registry import op8_document_fingerprints


def shingle_set(text):
    words = re.findall("[^\x20\x09-\x0d]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    return {tuple(words[k : k + 5]) for k in range(max(1, len(words) - 4))} if words else set()


def exact(a, b):
    a, b = shingle_set(a), shingle_set(b)
    return len(a & b) / len(a | b) if a | b else 1.0


def slow_sketch(text, k=128):
    """The definition in whole numbers of Python: least mixed sums of word hashes."""
    top, golden = 1 << 64, 0x9E3779B97F4A7C15

    def mixed(z):
        z = (z ^ z >> 30) * 0xBF58476D1CE4E5B9 % top
        z = (z ^ z >> 27) * 0x94D049BB133111EB % top
        return z ^ z >> 31

    found = set()
    for run in shingle_set(text):
        found.add(mixed((len(run) + sum(xxhash.xxh64_intdigest(w.encode(), 0) * (golden ** (j + 1) % top | 1) for j, w in enumerate(run))) % top))
    return sorted(found)[:k]


def slow_likeness(a, b, k=128):
    if not a and not b:
        return 1.0
    both = sorted(set(a) | set(b))[:k]
    return sum(h in a and h in b for h in both) / len(both)


def slow_code(one):
    return base64.b64encode(b"".join(h.to_bytes(8, "little") for h in one)).decode()


def test_estimates_and_merging():
    rng = random.Random(4)
    words = [f"w{k}" for k in range(4000)]
    a, b = " ".join(rng.choices(words, k=3000)), " ".join(rng.choices(words, k=2000))
    both = a + " " + b
    s, t = sk.sketch(a), sk.sketch(both)
    assert abs(sk.resemblance(s, t) - exact(a, both)) < 0.15
    assert sk.containment(s, t) > 0.85 and abs(sk.distinct(t) / 5000 - 1) < 0.3
    hashes = sk.shingle_hashes(both)
    parts = [sk.bottom_k(p) for p in np.array_split(hashes, 7)]
    assert np.array_equal(sk.merge(*parts), np.unique(hashes)[: sk.K]) and np.array_equal(sk.merge(*parts), t)
    repeated = np.repeat(np.arange(5, dtype=np.uint64), 5000)
    assert np.array_equal(sk.bottom_k(repeated), np.arange(5, dtype=np.uint64))
    assert np.array_equal(sk.decode(sk.encode(t)), t)
    assert sk.resemblance(sk.sketch(None), sk.sketch(" ")) == 1.0 and sk.resemblance(sk.sketch("a"), sk.sketch("")) == 0.0
    assert sk.resemblance(sk.sketch("A b"), sk.sketch("a  B\n")) == 1.0


def spark_hash(text):
    """Spark's xxhash64, a signed number."""
    value = xxhash.xxh64_intdigest(text.encode(), 42)
    return value - (1 << 64) if value >> 63 else value


def brute(docs):
    docs, out = sorted(docs, key=lambda d: (d[0] is not None, d[0] or 0, spark_hash(d[1]))), []
    for k, (doc, text) in enumerate(docs):
        following = docs[(k + 1) % len(docs)][1]
        new = text[: len(text) - len(text) // 4] + following[: len(text) // 4]
        own, other, after = slow_sketch(text), slow_sketch(new), slow_sketch(following)
        out.append((doc, len(text), hashlib.sha256(new.encode()).hexdigest(), slow_code(own), slow_code(other), slow_likeness(own, other), slow_likeness(own, after)))
    return sorted(out, key=str)


def test_query(spark, sf_dir):
    docs = [(r.doc_id, r.text or "") for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    rows = op8_document_fingerprints(spark, sf_dir).collect()
    assert sorted(map(tuple, rows), key=str) == brute(docs)
    texts = dict(docs)
    errors = [abs(r.near_edited - exact(texts[r.doc_id], sk.edited(texts[r.doc_id], texts[(r.doc_id + 1) % len(docs)]))) for r in rows]
    assert np.mean(errors) < 0.04 and max(errors) < 0.25


def test_edges(spark):
    schema = "doc_id long, text string, range int, after string"
    for rows in ([(5, "only one text " * 9, 1, "a")], [(None, None, 1, "x"), (3, "", 2, "x"), (3, "b c d", 2, None), (3, "b c d", 2, None), (7, "é🙂" * 50000, 0, ""), (None, "zz", 0, "")]):
        for parts in (1, 4):
            got = sk.beside_edited(spark.createDataFrame(rows, schema), parts=parts).collect()
            assert sorted(map(tuple, got), key=str) == brute([(r[0], r[1] or "") for r in rows])
    assert sk.beside_edited(spark.createDataFrame([], schema)).count() == 0


def test_merge_by(spark, monkeypatch):
    texts = [(k, f"alpha beta gamma delta epsilon {k % 7} zeta {k % 3}", "p" if k % 3 else None) for k in range(60)]
    made = sk.sketch_documents(spark.createDataFrame(texts, "doc_id long, text string, part string"))
    keyed = made.join(spark.createDataFrame([(k, p) for k, _, p in texts], "doc_id long, part string"), "doc_id")
    got = {r.part: r.fingerprint for r in sk.merge_by(keyed, "part").collect()}
    for part in ("p", None):
        assert got[part] == sk.encode(sk.merge(*(sk.sketch(t) for _, t, p in texts if p == part)))


def test_ranges_part_a_hot_id(spark):
    rows = [(None, f"text number {k}") for k in range(400)] + [(k // 3, f"other {k}") for k in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    for parts in (1, 7, 50):
        assert sorted(map(tuple, sk.beside_edited(docs, parts=parts).collect()), key=str) == brute(rows)
    ranges = sk.Ranges(np.array([-5, 3, 3, 3, 9]), np.array([7, -4, 0, 4, 1]))
    keys = [(-9, 0, 0), (-5, 8, 0), (0, 0, 0), (3, -9, 0), (3, -4, 1), (3, 3, 2), (3, 4, 3), (8, 0, 3), (9, 0, 3), (9, 1, 4), (10, -9, 4)]
    assert ranges.of(*(np.array(c) for c in list(zip(*keys))[:2])).tolist() == [r for _, _, r in keys]


def test_merge_by_of_nothing_and_of_ties(spark):
    schema = "doc_id long, fingerprint string, part string"
    assert sk.merge_by(spark.createDataFrame([], schema), "part").count() == 0
    one = sk.encode(sk.sketch("alpha beta gamma"))
    rows = [(1, one, "p"), (1, one, "p"), (2, None, "q"), (None, "", "q")]
    assert {r.part: (r.fingerprint, r.distinct_shingles) for r in sk.merge_by(spark.createDataFrame(rows, schema), "part").collect()} == {"p": (one, 1.0), "q": ("", 0.0)}
