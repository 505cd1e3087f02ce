"""Fingerprints against the definition; links against all pairs."""

import random
import re
from collections import Counter

import xxhash
from pyspark.sql import functions as F

from quillon.llm import simhash
from quillon.llm.registry import op3_simhash_near_dedup
from quillon.plans.components import components


def brute_print(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall("[^\x20\x09-\x0d]+", low)
    shingles = [" ".join(words[k : k + 3]) for k in range(max(1, len(words) - 2))] if words else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hashes) * 2 > len(hashes))


def brute_groups(prints, radius=2):
    ids, parent = list(prints), {d: d for d in prints}

    def root(d):
        while parent[d] != d:
            d = parent[d]
        return d

    for i, a in enumerate(ids):
        for b in ids[:i]:
            if (prints[a] ^ prints[b]).bit_count() <= radius:
                x, y = sorted((root(a), root(b)))
                parent[y] = x
    return {d: root(d) for d in ids}


def test_query(spark, sf_dir):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    rows = op3_simhash_near_dedup(spark, sf_dir).collect()
    prints = {d: brute_print(t) for d, t in docs.items()}
    groups = brute_groups(prints)
    assert {r.doc_id: (r.fingerprint, r.component_id) for r in rows} == {d: (f"{prints[d]:016x}", groups[d]) for d in docs}


def test_links_with_shards_dealt_again(spark):
    rng = random.Random(7)
    base = rng.getrandbits(64)
    values = {base ^ sum(1 << b for b in rng.sample(range(64), rng.randint(0, 4))) for _ in range(500)} | {rng.getrandbits(64) for _ in range(200)}
    signed = [v - (1 << 64) if v >> 63 else v for v in values]
    nodes = spark.createDataFrame([(v,) for v in signed], "fp long")
    want = brute_groups({s: s & (1 << 64) - 1 for s in signed})
    for size in (4, 10_000):
        roots = {r.node: r.root for r in components(simhash.near_links(nodes, shard_size=size)).collect()}
        sets, expect = {}, {}
        for s in signed:
            sets.setdefault(roots.get(s, s), set()).add(s)
            expect.setdefault(want[s], set()).add(s)
        assert sorted(map(sorted, sets.values())) == sorted(map(sorted, expect.values()))


def test_components_of_a_chain(spark):
    links = [(k, k + 1) for k in range(100, 160)] + [(5, 5), (7, 6), (6, 7)]
    rows = {r.node: r.root for r in components(spark.createDataFrame(links, "u long, v long")).collect()}
    assert rows == {k: 100 for k in range(101, 161)} | {7: 6}


def test_edges(spark):
    schema = "doc_id long, text string, fp string, component_id int"
    rows = [(4, None, "a", 1), (3, "", "b", 2), (None, " \n", "c", 3), (9, "one", "d", 4), (9, "one", "d", 4), (8, "ONE", None, None), (10, "w " * 300000, "", 0)]
    got = simhash.near_duplicates(spark.createDataFrame(rows, schema)).collect()
    assert sorted((r.doc_id or 0, r.component_id) for r in got) == [(0, 3), (3, 3), (4, 3), (8, 8), (9, 8), (9, 8), (10, 10)]
    assert simhash.near_duplicates(spark.createDataFrame([], schema)).count() == 0


def test_representatives_of_null_and_repeated_ids(spark):
    rows = [(None, "one of a kind", "a"), (None, "quite another text", "b"), (None, "quite another text", "c"), (None, "third without id", "d"), (5, "text x", "e"), (5, "text y", "f"), (5, "text y", "g"), (8, "text y", "h"), (2, "third without id", "i"), (9, None, "j"), (None, "", "k")]
    for docs in (rows, rows[::-1]):
        got = simhash.representatives(spark.createDataFrame(docs, "doc_id long, text string, key_a string").repartition(3))
        assert got.columns == ["doc_id", "text", "key_a"]
        assert sorted(((r.doc_id or 0, r.text) for r in got.collect()), key=str) == [(0, "one of a kind"), (0, "quite another text"), (2, "third without id"), (5, "text x"), (5, "text y"), (9, None)]


def brute_similar(texts, similarity=0.8):
    """Row number to the first row of its group, over all pairs of texts."""
    sets = []
    for text in texts:
        low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        words = re.findall("[^\x20\x09-\x0d]+", low)
        sets.append({tuple(words[k : k + 5]) for k in range(max(1, len(words) - 4))} if words else set())
    group = list(range(len(texts)))

    def root(k):
        while group[k] != k:
            k = group[k]
        return k

    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if not a and not b or a and b and len(a & b) >= similarity * len(a | b):
                x, y = sorted((root(i), root(j)))
                group[y] = x
    return [root(k) for k in range(len(texts))]


def families(rng, n, sizes):
    """Texts of which some are another with words replaced, from one to a third of them."""
    words, out = [f"w{k}" for k in range(3000)], []
    for _ in range(n):
        base = rng.choices(words, k=rng.randint(20, 150))
        for _ in range(rng.choice(sizes)):
            own = list(base)
            for _ in range(rng.randint(0, max(1, len(base) // 25))):
                own[rng.randrange(len(own))] = rng.choice(words)
            out.append(" ".join(own))
    rng.shuffle(out)
    return out


def test_representatives_against_all_pairs(spark, sf_dir):
    table = [r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").orderBy("doc_id").collect()]
    for texts in (table, families(random.Random(3), 60, [1, 2, 5, 12])):
        want = set(brute_similar(texts))
        docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(5)
        got = {r.doc_id for r in simhash.representatives(docs).collect()}
        assert len(want) < len(texts) and got == want


def test_large_families_in_deals_and_blocks(spark):
    """With a tiny shard size: dealt again twice, then blocks of which every two meet."""
    rng = random.Random(5)
    texts = families(rng, 1, [400]) + families(rng, 30, [1, 3])
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert {r.doc_id for r in simhash.representatives(docs, shard_size=100).collect()} == set(brute_similar(texts))


def test_chains_in_cells_of_any_size(spark):
    """Texts that are similar to the next ones only: no chain breaks between blocks."""
    words = [f"w{k}" for k in range(6200)]
    texts = [" ".join(words[k * 5 : k * 5 + 100]) for k in range(600)] + [" ".join(words[k * 5 : k * 5 + 100]) for k in range(700, 900)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert set(brute_similar(texts)) == {0, 600}
    for limits in ({"shard_size": 64}, {"shard_size": 256}, {"cell_bytes": 40_000}, {}):
        assert {r.doc_id for r in simhash.representatives(docs, **limits).collect()} == {0, 600}


def test_every_two_members_share_a_cell(spark):
    nodes = spark.range(200).select(F.col("id").cast("string").alias("fp"))
    for share in (0.5, 1.0, 1.2, 3.7):
        cells = [set(r.cells) for r in nodes.select(simhash._cells(F.lit(share)).alias("cells")).collect()]
        assert all(a & b for a in cells for b in cells)
        sizes = Counter(c for own in cells for c in own)
        assert max(sizes.values()) <= 200 / max(share, 1.0) * 1.5


def test_wide_fingerprint_in_chunks(monkeypatch):
    text = " ".join(f"w{k * k % 977}" for k in range(3000))
    whole = simhash.wide_fingerprint(text)
    monkeypatch.setattr(simhash, "WIDE_CHUNK", 100)
    parts = simhash.wide_fingerprint(text)
    assert whole[0] == parts[0] and whole[1].tolist() == parts[1].tolist() and len(whole[0]) * 8 == simhash.WIDE_BITS
    assert simhash.wide_fingerprint(None)[0] == bytes(64)


def test_representatives_of_odd_tables(spark):
    long = "many words of one long text " * 40_000
    rows = [(1, long, "a", None), (2, long + "more", "b", 1), (3, "ONE two", None, 2), (4, "one\tTWO", "", 3), (None, None, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, row string, fp int")
    got = simhash.representatives(docs)
    assert got.columns == docs.columns and sorted(r.doc_id or 0 for r in got.collect()) == [0, 1, 3]
    assert simhash.representatives(docs.limit(0)).count() == 0
