"""Source divergence: every row against exact integers by hand, however the work is cut."""

import re
from collections import Counter, defaultdict

import pytest

from quillon.llm import divergence
from quillon.llm.registry import op11_source_divergence

TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def f(p, q):
    return (p - q) ** 2 // (p + q)


def brute(rows, least=10, top=10):
    df, count = defaultdict(Counter), defaultdict(Counter)
    for lang, source, text in rows:
        lang, source, words = lang or "", source or "", TERM.findall((text or "").translate(LOWER))
        df[lang].update(set(words))
        count[lang, source].update(words)
    out = []
    for lang in df:
        kept = [t for t, n in df[lang].items() if n >= least]
        own = {s: c for (g, s), c in count.items() if g == lang}
        own[None] = sum(own.values(), Counter())
        share = {}
        for s, c in own.items():
            whole = sum(c[t] for t in kept) + 2 * len(kept)
            share[s] = {t: 1 + 10**9 * (c[t] + 2) // whole for t in kept}
        for s in own.keys() - {None}:
            apart = [(-sum(f(share[s][t], share[o][t]) for t in kept), o.encode(), o) for o in own if o not in (s, None)]
            out += [(lang, s, "pair", o, -v, k + 1) for k, (v, _, o) in enumerate(sorted(apart))]
            more = [(-f(share[s][t], share[None][t]), t.encode(), t) for t in kept if own[s][t] and share[s][t] > share[None][t]]
            out += [(lang, s, "term", t, -v, k + 1) for k, (v, _, t) in enumerate(sorted(more)[:top])]
    return sorted(out)


def result(df):
    return sorted(tuple(r) for r in df.collect())


def test_query(spark, sf_dir):
    rows = [(r.lang, r.source, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    assert result(op11_source_divergence(spark, sf_dir)) == brute(rows)


@pytest.mark.parametrize(("light", "tile_terms", "tile_groups"), [(0, 3, 2), (2, 4, 3), (3, 2048, 256), (99, 7, 2)])
def test_light_and_heavy_terms_add_up(spark, light, tile_terms, tile_groups):
    words = "Ab ab c d é É x7y z_z q".split()
    rows = [(f"l{k % 2}", f"s{k % 5 if k % 3 else k % 7}", " ".join(words[(k * j) % (3 + k % 7)] for j in range(k % 11))) for k in range(160)]
    rows += [("lone", "s", "only one group"), ("few", "a", "rare"), ("few", "b", None), (None, None, "c d"), ("", "x", "c")]
    docs = spark.createDataFrame([(*r, 1, 2) for r in rows], "lang string, source string, text string, g int, term int")
    assert result(divergence.audit(docs, 3, 4, light, tile_terms, tile_groups)) == brute(rows, 3, 4)


def test_edges(spark, monkeypatch):
    monkeypatch.setattr(divergence, "PIECE_BYTES", 64)
    monkeypatch.setattr(divergence, "FLUSH_TERMS", 5)
    rows = [("en", "long", "Word1other \x00 " * 500 + "x" * 1000)] * 12 + [("en", "empty", "")] * 3 + [("en", None, None)]
    docs = spark.createDataFrame(rows, "lang string, source string, text string")
    assert result(divergence.audit(docs)) == brute(rows)
    assert divergence.audit(docs.limit(0)).count() == 0


def test_shares_are_exact_beyond_64_bits(spark):
    count, whole = 7 * 10**13 + 5, 10**14 + 3
    made = spark.sql(f"SELECT {count}L AS c, {whole}L AS w").select(divergence.share(divergence.F.col("c"), divergence.F.col("w")).alias("p")).first()
    assert made.p == 1 + 10**9 * (count + 2) // whole
