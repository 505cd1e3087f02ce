"""Packing against brute force: encodings, bin sums, optimality on small cases."""

import itertools
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from tokenizers import Tokenizer

from quillon.llm import packing
from quillon.llm.encoding import WordEncoder
from quillon.llm.registry import op2_best_fit_packing, tokenizer_file

ODD_TEXTS = [
    None, "", " ", "\n\n", "  a  b\n\n c  ", "l'été's don't we'll 12³½ ²", "Ωmega ΣΑΣ İstanbul", "école",
    "\x1c\x1d a", "<|endoftext|> x", "a\t\tb\r\n", "日本語 text", "--- ... !!!", "\x85line\xa0x", "ǅ ß ẞ", "🙂 ok", "Əli ƁƆ Ⱥ", "end <|endoftext|> here", "a<|ENDOFTEXT|>b", "<|startoftext|>", "<|endof text|>",
]


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_encoder_equals_library(name, spark, sf_dir):
    enc = WordEncoder(tokenizer_file(name), max_words=500)
    texts = [r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("text").collect()] + ODD_TEXTS
    for part in (texts[:100], texts[100:], texts):
        flat, counts = enc.encode(part)
        want = [e.ids for e in Tokenizer.from_file(tokenizer_file(name)).encode_batch([t or "" for t in part], add_special_tokens=False)]
        assert counts.tolist() == [len(w) for w in want]
        assert flat.tolist() == list(itertools.chain.from_iterable(want))


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_encoder_equals_library_on_random_strings(name):
    path, rng = tokenizer_file(name), random.Random(name)
    library, ours = Tokenizer.from_file(path), WordEncoder(path)
    added = [t.content for t in library.get_added_tokens_decoder().values()]
    planes = [(0x20, 0x7E), (0x20, 0x24F), (0, 0xD7FF), (0xE000, 0xFFFF), (0x300, 0x370)]
    texts = []
    for _ in range(100_000):
        lo, hi = rng.choice(planes)
        text = "".join(chr(rng.randint(lo, hi)) if rng.random() < 0.7 else rng.choice("aZ e\n 1'") for _ in range(rng.randint(0, 12)))
        texts.append(text + rng.choice(added) + text[:3] if rng.random() < 0.1 else text)
    flat, counts = ours.encode(texts)
    want = [e.ids for e in library.encode_batch(texts, add_special_tokens=False)]
    ends = np.cumsum(counts)
    assert [t for t, w, e, n in zip(texts, want, ends, counts, strict=True) if flat[e - n : e].tolist() != w] == []


def test_fullest_is_optimal():
    rng = random.Random(1)
    for _ in range(200):
        counts = Counter(rng.choices(range(1, 25), k=rng.randint(1, 9)))
        room = rng.randint(0, 60)
        got = packing.fullest(counts, sorted(counts, reverse=True), room)
        assert all(got[n] <= counts[n] for n in got)
        items = list(counts.elements())
        best = max(s for k in range(len(items) + 1) for c in itertools.combinations(items, k) if (s := sum(c)) <= room)
        assert sum(n * m for n, m in got.items()) == best


def test_plan_places_every_piece_once():
    rng = np.random.default_rng(2)
    lengths = np.concatenate([rng.integers(1, 65, 500), np.full(300, 40), [64, 1]])
    plan = packing.plan_bins(dict(Counter(lengths.tolist())), 64)
    seen, bins = Counter(), defaultdict(list)
    for n in lengths.tolist():
        seq, off = packing.place(plan, np.array([n]), np.array([seen[n]]))
        seen[n] += 1
        bins[int(seq[0])].append((int(off[0]), n))
    assert set(bins) == set(range(plan.bins))
    for rows in bins.values():
        at = 0
        for off, n in sorted(rows):
            assert off == at
            at += n
        assert at <= 64
    assert packing.plan_bins({}).bins == 0


def test_query_against_brute_force(spark, sf_dir):
    docs = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    tok = Tokenizer.from_file(tokenizer_file("word_bpe_49k.json"))
    rows = op2_best_fit_packing(spark, sf_dir).collect()
    got, bins, total = defaultdict(dict), defaultdict(list), 0
    for r in rows:
        got[r.doc_id][r.piece] = (r.start, r.length, r.ids_crc32)
        bins[r.sequence_id].append((r.offset, r.length))
    for doc, text in docs.items():
        ids = tok.encode(text, add_special_tokens=False).ids + [1]
        total += len(ids)
        want = {k: (s, len(ids[s : s + 4096]), zlib.crc32(np.array(ids[s : s + 4096], "<u4").tobytes())) for k, s in enumerate(range(0, len(ids), 4096))}
        assert got[doc] == want
    for parts in bins.values():
        at = 0
        for off, n in sorted(parts):
            assert off == at
            at += n
        assert at <= 4096
    assert len(bins) <= -(-total // 4096) + 1


def test_edges(spark):
    schema = "doc_id long, text string, part string, length string, rank int"
    rows = [(1, None, "x", "y", 1), (1, None, "x", "y", 1), (None, "", None, None, None), (2, "word " * 20000, "p", "q", 2)]
    path = tokenizer_file("word_bpe_49k.json")
    got = packing.pack_documents(spark.createDataFrame(rows, schema), path).collect()
    assert sorted((r.doc_id or 0, r.length) for r in got) == [(0, 1), (1, 1), (1, 1), (2, 20001 - 4 * 4096), *[(2, 4096)] * 4]
    assert packing.pack_documents(spark.createDataFrame([], schema), path).count() == 0
    packed = packing.pack_documents(spark.createDataFrame(rows[:3], schema), path, keep_ids=True)
    assert [list(r.ids) for r in packing.sequences(packed).collect()] == [[1, 1, 1]]


def test_sequences_of_nothing_and_of_ties(spark):
    path = tokenizer_file("word_bpe_49k.json")
    none = packing.pack_documents(spark.createDataFrame([], "doc_id long, text string"), path, keep_ids=True)
    assert packing.sequences(none).count() == 0
    same = packing.pack_documents(spark.createDataFrame([(1, "one two")] * 5, "doc_id long, text string"), path, keep_ids=True)
    (only,) = packing.sequences(same).collect()
    assert only.length == 15 and list(only.ids) == list(only.ids)[:3] * 5
