"""Benchmark decontamination: BM25 over the test items with block-max WAND.

The inverted index is of the test items; every passage of every document is a
query. A posting's weight is its BM25 score over the item's score against itself,
so an item that a passage holds whole scores 1 and one threshold fits all items.
Passages are windows of twice the longest item's words, half overlapping, so any
occurrence of an item lies whole in one.

Block-max WAND, for many passages at a time: with a passage's terms by rising
bound (largest weight), the pivot is the first at which the bounds add up to the
threshold; a block of items that holds none of the pivot and later terms is never
opened. Of the opened blocks, those whose block maxima over all terms do not
reach the threshold are skipped, and only the postings of the rest are scored,
exactly. What is retrieved is then verified: word shingles of the item (with an
``answer`` column: of the question and of the answer) must be in the passage.

The index is broadcast in blocks of at most ``BLOCK_ITEMS`` items and
``BLOCK_WORDS`` words, with statistics over all items, and all passages are
searched against every block.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.llm.learning import bounded_batches, by_place

K1, B = 1.2, 0.75
RETRIEVE = 0.5  # share of an item's score against itself
OVERLAP = 0.8  # share of an item's shingles in the passage
SHINGLE_WORDS = 5
POSTING_BLOCK = 8
BLOCK_ITEMS, BLOCK_WORDS = 20_000, 2_000_000
DENSE_CELLS = 4_000_000
BATCH_DOCS, PASSAGES = 64, 256  # searched at a time
WORD = re.compile(r"[^\W_]+")
SENTENCE = re.compile(r"(?<=[.!?])\s+")

SCHEMA = "doc_id long, item_id long, score double, overlap double, question_overlap double, answer_overlap double, first_word long"


def words_of(text: str | None) -> list[str]:
    return WORD.findall((text or "").lower())


def question_and_answer(text: str | None) -> tuple[str, str]:
    """An item without an answer of its own ends in it: its last sentence, if it has several."""
    parts = SENTENCE.split((text or "").strip())
    return (" ".join(parts[:-1]), parts[-1]) if len(parts) > 1 else (parts[0], "")


def shingles(words: list[str], width: int = SHINGLE_WORDS) -> set[tuple[str, ...]]:
    """Runs of ``width`` words; fewer words are one run."""
    if len(words) < width:
        return {tuple(words)} if words else set()
    return set(zip(*(words[k:] for k in range(width)), strict=False))


@dataclass
class Item:
    item_id: int
    question: list[str]
    answer: list[str]
    split: bool  # the answer is a column of its own

    @property
    def words(self) -> list[str]:
        return self.question + self.answer


def _spans(lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The numbers of all ranges ``lo`` to ``hi`` one after the other, and whose they are."""
    n = hi - lo
    ends = np.cumsum(n)
    total = int(ends[-1]) if len(ends) else 0
    return np.arange(total) + np.repeat(lo - (ends - n), n), np.repeat(np.arange(len(n)), n)


class Index:
    """Inverted index of items with block maxima, in arrays sorted by term.

    ``width`` is the longest item's number of words, over all blocks of the index.
    """

    def __init__(self, items: list[Item], n_items: int, mean_words: float, df: dict[str, int], width: int) -> None:
        self.items, self.width = items, max(1, width)
        self.vocabulary = {w: k for k, w in enumerate(sorted({w for i in items for w in i.words}))}
        postings: list[tuple[int, int, float]] = []
        for at, item in enumerate(items):
            counts, norm = Counter(item.words), K1 * (1 - B + B * len(item.words) / max(mean_words, 1e-9))
            idf = {w: np.log1p((n_items - df[w] + 0.5) / (df[w] + 0.5)) for w in counts}
            own = {w: idf[w] * c * (K1 + 1) / (c + norm) for w, c in counts.items()}
            whole = sum(own.values())
            postings += [(self.vocabulary[w], at, v / whole) for w, v in own.items()]
        postings.sort()
        table = np.array(postings, np.float64).reshape(-1, 3)
        terms, n = table[:, 0].astype(np.int64), len(self.vocabulary)
        self.n_blocks = -(-max(1, len(items)) // POSTING_BLOCK)
        self.room = self.n_blocks * POSTING_BLOCK
        self.posting, self.weight = terms * self.room + table[:, 1].astype(np.int64), table[:, 2]
        block = self.posting // POSTING_BLOCK  # term * n_blocks + block of items
        cut = np.flatnonzero(np.diff(block, prepend=-1))
        self.block, self.block_max = block[cut], np.maximum.reduceat(self.weight, cut) if len(cut) else np.zeros(0)
        self.block_start = np.searchsorted(self.block, np.arange(n + 1) * self.n_blocks)
        self.dense = None  # the block maxima in a table, where it is small
        if n * self.n_blocks <= DENSE_CELLS:
            self.dense = np.zeros(n * self.n_blocks)
            self.dense[self.block] = self.block_max
        self.term_max = np.maximum.reduceat(self.weight, np.searchsorted(terms, np.arange(n))) if n else np.zeros(0)

    def _maximum(self, block: np.ndarray) -> np.ndarray:
        """Largest weights of (term, block of items), zero where there is none."""
        if self.dense is not None:
            return self.dense[block]
        at = np.minimum(np.searchsorted(self.block, block), len(self.block) - 1)
        return np.where(self.block[at] == block, self.block_max[at], 0.0)

    def search(self, query: np.ndarray, term: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(query, item, score) of all items that reach the threshold.

        ``query, term`` are the distinct terms of queries numbered from 0, sorted.
        """
        none = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
        enough = threshold - 1e-9  # bounds are sums in another order than scores
        if not len(query):
            return none
        # The pivot: terms by rising bound; what holds only terms before it scores too little.
        order = np.lexsort((self.term_max[term], query))
        query, term = query[order], term[order]
        start = np.searchsorted(query, np.arange(query[-1] + 2))
        total = np.concatenate([[0.0], np.cumsum(self.term_max[term])])
        opening = np.flatnonzero(total[1:] - total[start[query]] >= enough)
        rows, owner = _spans(self.block_start[term[opening]], self.block_start[term[opening] + 1])
        opened = np.unique(query[opening][owner] * self.n_blocks + self.block[rows] % self.n_blocks)
        # Block maxima of all terms, in the opened blocks alone.
        asked, block = opened // self.n_blocks, opened % self.n_blocks
        rows, owner = _spans(start[asked], start[asked + 1])
        start_of = np.concatenate([[0], np.cumsum(start[asked + 1] - start[asked])])[:-1]
        wanted = term[rows] * self.n_blocks + block[owner]
        bound = np.add.reduceat(self._maximum(wanted), start_of) if len(opened) else np.zeros(0)
        alive = np.flatnonzero(bound >= enough)
        # Exact scores of the items of the blocks that are left.
        asked, block = asked[alive], block[alive]
        rows, owner = _spans(start[asked], start[asked + 1])
        first = term[rows] * self.room + block[owner] * POSTING_BLOCK
        rows, part = _spans(np.searchsorted(self.posting, first), np.searchsorted(self.posting, first + POSTING_BLOCK))
        score = np.bincount(owner[part] * POSTING_BLOCK + self.posting[rows] % POSTING_BLOCK, self.weight[rows], len(alive) * POSTING_BLOCK)
        found = np.flatnonzero(score >= threshold)
        return asked[found // POSTING_BLOCK], block[found // POSTING_BLOCK] * POSTING_BLOCK + found % POSTING_BLOCK, score[found]


def _verify(item: Item, passage: list[str]) -> tuple[float, float, float]:
    """Overlap of the whole item, its question and its answer with a passage."""
    seen: dict[int, set] = {}

    def share(words: list[str]) -> float:
        own = shingles(words)
        if not own:
            return 1.0
        width = min(SHINGLE_WORDS, len(words))
        if width not in seen:
            seen[width] = shingles(passage, width)
        return len(own & seen[width]) / len(own)

    return share(item.words), share(item.question), share(item.answer)


def passages(n_words: int, width: int) -> np.ndarray:
    """Starts of a text's passages of ``2 * width`` words, half overlapping."""
    return np.arange(0, max(1, n_words - width), width)


def find_in(index: Index, texts: list[list[str]], retrieve: float, overlap: float) -> list[dict[int, tuple]]:
    """For each text, given as words, the best verified passage of each item."""
    found: list[dict[int, tuple]] = [{} for _ in texts]
    todo = [(k, lo) for k, words in enumerate(texts) for lo in passages(len(words), index.width).tolist()]
    ids = [np.fromiter(map(index.vocabulary.get, words, repeat(-1)), np.int64, len(words)) for words in texts]
    for at in range(0, len(todo), PASSAGES):
        part = todo[at : at + PASSAGES]
        own = [ids[k][lo : lo + 2 * index.width] for k, lo in part]
        query, term = np.repeat(np.arange(len(own)), [len(o) for o in own]), np.concatenate(own)
        distinct = np.unique((query * len(index.vocabulary) + term)[term >= 0])
        hits = index.search(*np.divmod(distinct, max(1, len(index.vocabulary))), retrieve)
        for n, item_at, score in zip(*(h.tolist() for h in hits), strict=True):
            k, lo = part[n]
            item = index.items[item_at]
            whole, question, answer = _verify(item, texts[k][lo : lo + 2 * index.width])
            passed = min(question, answer) >= overlap if item.split else whole >= overlap
            if passed and (item_at not in found[k] or (whole, score) > found[k][item_at][:2]):
                found[k][item_at] = (whole, score, question, answer, lo)
    return found


def read_items(benchmark: DataFrame, block: int, blocks: int) -> list[Item]:
    """The items of one block; bounded by its share of the items."""
    rows = benchmark.filter(F.col("item_id").isNotNull() & (F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == block))
    split = "answer" in benchmark.columns
    items = []
    for r in rows.collect():
        question, answer = (r.text, r.answer) if split else question_and_answer(r.text)
        item = Item(r.item_id, words_of(question), words_of(answer), split)
        if item.words:
            items.append(item)
    return sorted(items, key=lambda i: (i.item_id, i.words))


def _terms(benchmark: DataFrame) -> DataFrame:
    """Distinct words of each item, with its length, by the index's own rule."""
    text = F.concat_ws(" ", "text", "answer") if "answer" in benchmark.columns else F.col("text")

    def run(batches):
        for batch in batches:
            texts = [words_of(t) for t in batch.column("t").to_pylist()]
            sets = [sorted(set(w)) for w in texts]
            yield pa.RecordBatch.from_arrays([pa.array(sets, pa.list_(pa.string())), pa.array(list(map(len, texts)), pa.int64())], ["words", "n"])

    return benchmark.filter("item_id IS NOT NULL").select(text.cast("string").alias("t")).mapInArrow(run, "words array<string>, n long")


def contaminated(docs: DataFrame, benchmark: DataFrame, retrieve: float = RETRIEVE, overlap: float = OVERLAP) -> DataFrame:
    """One row for each document and item that it holds, with the best passage.

    Of equally good passages the first counts. Whole texts are searched, however
    long; only ``doc_id`` and ``text`` of ``docs`` are read, whatever other
    columns there are.

    ``benchmark`` has ``item_id``, ``text`` and perhaps ``answer``; with an answer
    both it and the question must overlap, without one the item as a whole. Null
    and empty texts hold nothing; null item ids are left out; repeated documents
    each get their rows; an empty benchmark gives none.
    """
    texts = bounded_batches(docs).select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    parts = [texts.mapInArrow(_searcher(shared, retrieve, overlap), SCHEMA) for shared in _indexes(benchmark)]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def _indexes(benchmark: DataFrame) -> Iterator[Broadcast[Index]]:
    """The index in blocks, each broadcast; at least one."""
    sizes = _terms(benchmark)
    n_items, n_words, width = sizes.filter("n > 0").agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.max("n"), F.lit(1))).first()
    blocks = max(-(-n_items // BLOCK_ITEMS), -(-n_words // BLOCK_WORDS), 1)
    counts = sizes.select(F.explode("words").alias("word")).groupBy("word").agg(F.count("*").alias("df"))
    for block in range(blocks):
        items = read_items(benchmark, block, blocks)
        index = Index(items, n_items, n_words / max(1, n_items), _document_frequencies(counts, items), width)
        yield benchmark.sparkSession.sparkContext.broadcast(index)


def _document_frequencies(counts: DataFrame, items: list[Item]) -> dict[str, int]:
    """Frequencies over all items of the words of one block's items."""
    own = sorted({w for i in items for w in i.words})
    spark, found = counts.sparkSession, {}
    wanted = spark.createDataFrame([(w,) for w in own], "word string")
    for r in counts.join(wanted, "word", "left_semi").collect():
        found[r.word] = r.df
    return found


def _searcher(shared, retrieve: float, overlap: float):
    def run(batches):
        index = shared.value
        for batch in batches:
            rows = []
            for at in range(0, batch.num_rows, BATCH_DOCS):
                few = batch.slice(at, BATCH_DOCS)
                found = find_in(index, [words_of(t) for t in few.column("text").to_pylist()], retrieve, overlap)
                for doc, hits in zip(few.column("doc_id").to_pylist(), found, strict=True):
                    for item_at, (whole, score, question, answer, lo) in hits.items():
                        rows.append((doc, index.items[item_at].item_id, score, whole, question, answer, lo))
            kinds = [pa.int64(), pa.int64(), *[pa.float64()] * 4, pa.int64()]
            names = [part.split()[0] for part in SCHEMA.split(", ")]
            columns = zip(*rows, strict=True) if rows else [()] * 7
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names)

    return run


def _cleaner(shared, text: str, retrieve: float, overlap: float):
    def run(batches):
        index = shared.value
        for whole in batches:
            for at in range(0, whole.num_rows, BATCH_DOCS):
                batch = whole.slice(at, BATCH_DOCS)
                hits = find_in(index, [words_of(t) for t in batch.column(text).to_pylist()], retrieve, overlap)
                yield batch.filter(pa.array([not h for h in hits], pa.bool_()))

    return run


def clean_documents(docs: DataFrame, benchmark: DataFrame, retrieve: float = RETRIEVE, overlap: float = OVERLAP) -> DataFrame:
    """The rows of ``docs``, all columns, whose own text holds no item, whatever their ``doc_id``.

    Null and empty texts stay, as do all rows where the benchmark is empty;
    repeated rows are judged each; columns may have any names.
    """
    kept, text = by_place(docs)
    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in kept.schema)
    for shared in _indexes(benchmark):
        kept = kept.mapInArrow(_cleaner(shared, text, retrieve, overlap), kinds)
    return kept.select(*[f"c{i}" for i in range(len(docs.columns))]).toDF(*docs.columns)
