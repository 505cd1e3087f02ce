"""Merkle manifest: leaves, roots, proofs and tampering against a tree built by hand."""

import hashlib
import zlib

from pyspark.sql import functions as F

from quillon.llm import manifest
from quillon.llm.registry import op13_merkle_manifest


def h(text):
    return hashlib.sha256(text.encode() if isinstance(text, str) else text).hexdigest()


def field(value):
    return b"-" if value is None else b"%d:%s" % (len(str(value).encode()), str(value).encode())


def leaf(row, more=0):
    doc_id, source, lang, n_chars, text = row
    return h(b"".join(map(field, (doc_id, source, lang, None if n_chars is None else n_chars + more, text))))


def tree(nodes):
    levels = [nodes]
    while len(levels[-1]) > 1:
        levels.append([h("".join(levels[-1][k : k + 2])) for k in range(0, len(levels[-1]), 2)])
    return levels


def siblings(levels, at):
    for nodes in levels[:-1]:
        yield nodes[at ^ 1] if at ^ 1 < len(nodes) else "", at % 2 == 1
        at //= 2


def brute(rows):
    groups = {}
    for row in rows:
        groups.setdefault(row[2], []).append(((row[0] is not None, row[0] or 0), leaf(row), row))
    trees = {lang: tree([x[1] for x in sorted(own, key=lambda x: x[:2])]) for lang, own in groups.items()}
    langs = sorted(groups, key=lambda v: (v is not None, (v or "").encode()))
    top, out = tree([trees[v][-1][0] for v in langs]), []
    for lang, own in groups.items():
        for at, (_, digest, row) in enumerate(sorted(own, key=lambda x: x[:2])):
            proof = [*siblings(trees[lang], at), *siblings(top, langs.index(lang))]
            tampered = row[0] is not None and row[3] is not None and zlib.crc32(str(row[0]).encode()) % 7 == 0
            folded = leaf(row, 1) if tampered else digest
            for sibling, left in proof:
                folded = h(sibling + folded if left else folded + sibling)
            out.append((str(row[0]), digest, trees[lang][-1][0], top[-1][0], h("".join(s for s, _ in proof)), folded, folded == top[-1][0]))
    return sorted(out)


def result(df):
    return sorted((str(r.doc_id), r.leaf, r.subroot, r.root, r.proof_sha256, r.folded_root, r.verified) for r in df.collect())


def test_query(spark, sf_dir):
    rows = [(r.doc_id, r.source, r.lang, r.n_chars, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    got = result(op13_merkle_manifest(spark, sf_dir))
    assert got == brute(rows) and 0 < sum(not r[-1] for r in got) < len(got) / 3


def test_edges(spark, monkeypatch):
    rows = [(None, "s", "en", 1, "a"), (None, None, None, None, None), (5, "s", "en", None, ""), (5, "s", "en", None, ""), (7, "t", "zz", 3, "é")]
    rows += [(5, "t", "en", 2**63 - 1, "x" * 100_000), (15, "", "", 0, "q"), (20, "", "", 0, "q")] + [(3, "s", "hot", 3, "t")] * 70
    rows += [(k, "s", "hot", k, "t") for k in range(77)]
    docs = spark.createDataFrame([(r[0], r[4], r[2], r[1], r[3], "x", 1) for r in rows], "doc_id long, text string, lang string, source string, n_chars long, g string, idx int")
    want = brute(rows)
    for stride in (8, 1, 3):
        monkeypatch.setattr(manifest, "STRIDE", stride)
        assert result(manifest.verify_documents(docs)) == want
    assert manifest.verify_documents(docs.limit(0)).count() == 0


def test_a_proof_does_not_fit_another_leaf(spark):
    rows = spark.createDataFrame([("=a", k, f"{k:064x}") for k in range(9)], "g string, doc_id long, hex string").withColumn("digest", F.unhex("hex"))
    made = manifest.manifest(rows, "doc_id", ["doc_id"])
    wrong = F.unhex(F.sha2(F.hex("digest").cast("binary"), 256))
    got = made.select(manifest.fold(F.col("digest"), F.col("proof")).alias("right"), manifest.fold(wrong, F.col("proof")).alias("wrong"), "root").collect()
    assert len(got) == 9 and all(r.right == r.root != r.wrong for r in got)
