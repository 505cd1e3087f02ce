"""Source divergence audit: how far the word use of sources lies apart in a language.

Every (language, source) group gives each kept term of its language a smoothed
share p in whole billionths; two shares p and q differ by
``f = floor((p - q)^2 / (p + q))``, and two groups by the sum of f over all kept
terms. All of it is integer arithmetic, so partial sums add up exactly in any order.

The sum is split by how many groups have a term:

* terms of more than ``light`` groups are laid out as dense numpy tiles, terms by
  groups, in which absent counts are filled in;
* a rarer term differs from its absence only in the few groups that have it. What
  all rare terms would give if no group had them is one product; what a group adds
  against groups without the term depends on its own share alone, so a histogram of
  shares is enough; and the pairs of groups that both have it get a correction from
  its posting list, added up in the task that holds the list.

Words are counted within the tasks that read the texts; what is shuffled is a row
for each term and group of a task, so a source with a third of all rows is
no heavier than another.
"""

from __future__ import annotations

from collections import Counter, defaultdict

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillon.plans.staging import bounded_batches, stage

SCALE = 1_000_000_000
LEAST_DOCS = 10
TOP_TERMS = 10
LIGHT = 8  # a term of at most so many groups is rare
TILE_TERMS, TILE_GROUPS = 2048, 256
FLUSH_TERMS = 200_000
PIECE_BYTES = 1 << 20

# Terms are runs of ASCII letters and of everything beyond ASCII; only A-Z is lowered.
# On UTF-8 all other bytes part them, and no byte of a longer character is ASCII.
_FOLD = bytes(b | 0x20 if 0x41 <= b <= 0x5A else b if 0x61 <= b <= 0x7A or b >= 0x80 else 0x20 for b in range(256))

_TALLY = pa.schema([("lang", pa.string()), ("source", pa.string()), ("term", pa.binary()), ("docs", pa.int64()), ("count", pa.int64())])


def pieces(text: bytes):
    """Lists of the text's terms; a long text comes in pieces cut between terms."""
    at = 0
    while at < len(text):
        end = text.find(b" ", at + PIECE_BYTES)
        end = end if end >= 0 else len(text)
        yield text[at:end].split(b" ")
        at = end


def tallies(docs: DataFrame) -> DataFrame:
    """``lang, source, term, docs, count``: a row for each term of a group.

    The row with the empty term stands for the group itself, with its documents.
    """

    def run(batches):
        held: dict = {}
        size = 0
        for batch in batches:
            for lang, source, text in zip(*(batch.column(c).to_pylist() for c in ("lang", "source", "text")), strict=True):
                counts, within = held.setdefault((lang, source), (Counter(), Counter()))
                before, own = len(counts), set()
                for words in pieces(text.translate(_FOLD)):
                    counts.update(words)
                    own.update(words)
                own.discard(b"")
                within.update(own)
                within[b""] += 1
                size += len(counts) - before
                if size > FLUSH_TERMS:
                    yield table(held)
                    held, size = {}, 0
        if held:
            yield table(held)

    def table(held):
        rows = ((lang, source, term, n, counts[term] if term else 0) for (lang, source), (counts, within) in held.items() for term, n in within.items())
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), _TALLY.types, strict=True)], schema=_TALLY)

    columns = [F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("lang", "source", "text")]
    rows = bounded_batches(docs).select(columns[0].alias("lang"), columns[1].alias("source"), columns[2].cast("binary").alias("text"))
    made = rows.mapInArrow(run, "lang string, source string, term binary, docs long, count long")
    return made.groupBy("lang", "source", F.col("term").cast("string").alias("term")).agg(F.sum("docs").alias("docs"), F.sum("count").alias("count"))


def kept_terms(docs: DataFrame, least_docs: int = LEAST_DOCS) -> DataFrame:
    """Postings of the terms in at least ``least_docs`` documents of their language.

    ``lang, source, term, count``, the term's ``total`` in the language and its
    number of ``groups``, with a mark at the ``first`` of them; the empty term keeps
    every group.
    """
    term = Window.partitionBy("lang", "term")
    seen = tallies(docs).withColumns({
        "df": F.sum("docs").over(term),
        "total": F.sum("count").over(term),
        "groups": F.count("*").over(term),
        "first": F.col("source") == F.min("source").over(term),
    })
    return seen.filter((F.col("term") == "") | (F.col("df") >= least_docs)).select("lang", "source", "term", "count", "total", "groups", "first")


def share(count, whole):
    """1 + floor(SCALE * (count + 2) / whole), exact also where the product outgrows 64 bits."""
    top = (count + 2).cast("decimal(20,0)") * F.lit(SCALE).cast("decimal(10,0)")
    return F.when(whole > 0, F.call_function("div", top, whole.cast("decimal(20,0)")) + 1)


def divergence(p, q):
    """f of two columns of shares; the square stays below 2^63, since no share exceeds SCALE + 1."""
    return F.call_function("div", (p - q) * (p - q), p + q)


def _f(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    apart = p - q
    return apart * apart // (p + q)


def groups_of(postings: DataFrame, light: int = LIGHT, tile_terms: int = TILE_TERMS, tile_groups: int = TILE_GROUPS) -> DataFrame:
    """Every group with its number in its language, its totals and how the work is cut.

    The numbering sorts the groups of a language, of which the result has all pairs.
    """
    own = postings.groupBy("lang", "source").agg(F.sum("count").alias("n"))
    heavy = F.count(F.when(F.col("groups") > light, 1))
    terms = postings.filter(F.col("first") & (F.col("term") != ""))
    langs = terms.groupBy("lang").agg(F.count("*").alias("v"), F.sum("total").alias("lang_n"), heavy.alias("heavy"))
    lang = Window.partitionBy("lang")
    numbered = own.withColumn("number", (F.row_number().over(lang.orderBy("source")) - 1).cast("long"))
    numbered = numbered.withColumn("block", F.expr(f"cast(number div {tile_groups} as int)"))
    numbered = numbered.withColumn("blocks", F.max("block").over(lang) + 1)
    joined = numbered.join(langs, "lang", "left").na.fill(0, ["v", "lang_n", "heavy"])
    whole = F.col("n") + 2 * F.col("v")
    return joined.withColumns({
        "whole": whole,
        "lang_whole": F.col("lang_n") + 2 * F.col("v"),
        "p0": F.coalesce(share(F.lit(0), whole), F.lit(0)),
        "slices": F.greatest(F.lit(1), F.ceil(F.col("heavy") / tile_terms)).cast("int"),
    })


_PARTS = "lang string, g long, h long, value long"


def _pairs_of_blocks(rows: DataFrame) -> DataFrame:
    """Each row of a group to every pair of blocks that its block is part of."""
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    return rows.withColumn("other", other).withColumns({"a": F.least("block", "other"), "b": F.greatest("block", "other")}).drop("other")


def _tile(key: tuple, cells: pd.DataFrame, groups: pd.DataFrame) -> pd.DataFrame:
    """Sums over one slice of the terms for all pairs of two blocks of groups.

    ``cells`` are shares: of a term for heavy terms, and ``weight`` rare terms of
    that share (without a term) otherwise.
    """
    lang, a, b, part = key
    groups = groups.sort_values("number")
    number, p0, block = (groups[c].to_numpy("int64") for c in ("number", "p0", "block"))
    left, right = np.flatnonzero(block == a), np.flatnonzero(block == b)
    sums = np.zeros((len(left), len(right)), np.int64)
    v = int(groups["v"].iloc[0]) if len(groups) else 0
    if v:
        absent = _f(p0[left][:, None], p0[right][None, :])
        if part == 0:
            sums += absent * v  # as if no group had any term; the rest is what having it changes
        at = np.searchsorted(number, cells["number"].to_numpy("int64"))
        p, weight, code = cells["p"].to_numpy("int64"), cells["weight"].to_numpy("int64"), pd.factorize(cells["term"])[0]
        dense = weight == 0
        _add_dense(sums, absent, p0, left, right, at[dense], p[dense], code[dense])
        _add_one_sided(sums, absent, p0, left, right, at[~dense], p[~dense], weight[~dense])
    i, j = np.meshgrid(left, right, indexing="ij")
    once = number[i] < number[j]
    return pd.DataFrame({"lang": lang, "g": number[i][once], "h": number[j][once], "value": sums[once]})


def _add_dense(sums, absent, p0, left, right, at, p, code) -> None:
    """Terms by groups, absent shares filled in; a run of terms at a time."""
    order = np.argsort(code, kind="stable")
    at, p = at[order], p[order]
    starts = np.flatnonzero(np.diff(code[order], prepend=-1))
    row = np.repeat(np.arange(len(starts)), np.diff(np.append(starts, len(order))))
    step = 256
    for first in range(0, len(starts), step):
        own = (row >= first) & (row < first + step)
        matrix = np.broadcast_to(p0, (min(step, len(starts) - first), len(p0))).copy()
        matrix[row[own] - first, at[own]] = p[own]
        other = matrix[:, right]
        for k, g in enumerate(left.tolist()):
            sums[k] += _f(matrix[:, g : g + 1], other).sum(axis=0) - len(matrix) * absent[k]


def _add_one_sided(sums, absent, p0, left, right, at, p, weight) -> None:
    """Rare terms of one group against the absence of the other."""
    for mine, theirs, turned in ((left, right, False), (right, left, True)):
        for k, g in enumerate(mine.tolist()):
            own = at == g
            base = absent[:, k] if turned else absent[k]
            gain = np.zeros(len(theirs), np.int64)
            for first in range(0, int(own.sum()), 4096):
                part, times = p[own][first : first + 4096, None], weight[own][first : first + 4096, None]
                gain += ((_f(part, p0[theirs][None, :]) - base[None, :]) * times).sum(axis=0)
            if turned:
                sums[:, k] += gain
            else:
                sums[k] += gain


def _corrections(batches):
    """Posting pairs of rare terms: what two groups that both have a term really
    give, less what the one-sided sums made of it; added up over a batch."""
    for batch in batches:
        sizes: dict = defaultdict(list)
        for lang, posting in zip(batch.column("lang").to_pylist(), batch.column("posting").to_pylist(), strict=True):
            sizes[len(posting)].append((lang, sorted((x["number"], x["p"], x["p0"]) for x in posting)))
        found = []
        for size, terms in sizes.items():
            langs = [lang for lang, _ in terms]
            cells = np.array([posting for _, posting in terms], np.int64)
            for i in range(size):
                for j in range(i + 1, size):
                    (g, p, p0), (h, q, q0) = cells[:, i].T, cells[:, j].T
                    gain = _f(p, q) - _f(p, q0) - _f(p0, q) + _f(p0, q0)
                    found.append(pd.DataFrame({"lang": langs, "g": g, "h": h, "value": gain}))
        if found:
            sums = pd.concat(found).groupby(["lang", "g", "h"], as_index=False)["value"].sum()
            yield pa.RecordBatch.from_pandas(sums, pa.schema([("lang", pa.string()), ("g", pa.int64()), ("h", pa.int64()), ("value", pa.int64())]), preserve_index=False)


def pair_sums(postings: DataFrame, groups: DataFrame, light: int = LIGHT) -> DataFrame:
    """``lang, g, h, value`` for every two groups g < h of a language, by number.

    ``postings`` are shares ``lang, number, block, blocks, slices, term, groups, p, p0``.
    """
    keys = ["lang", "a", "b", "part"]
    shape = ["lang", "number", "block", "blocks", "slices"]
    heavy = postings.filter(F.col("groups") > light).withColumn("part", F.pmod(F.xxhash64("term"), F.col("slices").cast("long")).cast("int"))
    dense = _pairs_of_blocks(heavy).select(*keys, "number", "p", F.lit(0).cast("long").alias("weight"), "term")
    shares = postings.filter(F.col("groups") <= light).groupBy(*shape, "p").agg(F.count("*").alias("weight"))
    sided = _pairs_of_blocks(shares.withColumn("part", F.pmod("p", F.col("slices").cast("long")).cast("int")))
    sided = sided.select(*keys, "number", "p", "weight", F.lit(None).cast("string").alias("term"))
    spread = _pairs_of_blocks(groups).withColumn("part", F.explode(F.sequence(F.lit(0), F.col("slices") - 1)))
    spread = spread.select(*keys, "number", "block", "p0", "v")
    spread = spread.toDF(*spread.columns)  # columns of its own, as both sides come from one table

    tiles = dense.unionByName(sided).groupBy(*keys).cogroup(spread.groupBy(*keys)).applyInPandas(_tile, _PARTS)
    rare = postings.filter((F.col("groups") <= light) & (F.col("groups") > 1)).groupBy("lang", "term")
    rare = rare.agg(F.collect_list(F.struct("number", "p", "p0")).alias("posting")).select("lang", "posting")
    both = tiles.unionByName(rare.mapInArrow(_corrections, _PARTS))
    return both.groupBy("lang", "g", "h").agg(F.sum("value").alias("value"))


def audit(
    docs: DataFrame, least_docs: int = LEAST_DOCS, top_terms: int = TOP_TERMS, light: int = LIGHT, tile_terms: int = TILE_TERMS, tile_groups: int = TILE_GROUPS
) -> DataFrame:
    """``lang, source, part, item, value, rank`` of every group.

    Part ``pair`` has every other source of the language by falling divergence, part
    ``term`` the ``top_terms`` terms that the source uses more than its language.
    Equal values rank by the bytes of the item.

    Null texts, languages and sources are empty strings; a group without a kept term
    has its pairs all the same, with value 0 where the language keeps none. Texts of
    any length are read whole, repeated rows count as often as they are there, other
    columns are not read, an empty table gives no rows. ``light``, ``tile_terms`` and
    ``tile_groups`` only place the work.
    """
    postings = stage(kept_terms(docs, least_docs), "kept-terms")
    groups = stage(groups_of(postings, light, tile_terms, tile_groups), "term-groups")
    shares = postings.filter("term <> ''").join(groups, ["lang", "source"])
    shares = shares.withColumn("p", share(F.col("count"), F.col("whole")))

    sums = pair_sums(shares, groups, light)
    ends = F.explode(F.array(F.struct(F.col("g").alias("number"), F.col("h").alias("other")), F.struct(F.col("h").alias("number"), F.col("g").alias("other"))))
    pairs = sums.select("lang", "value", ends.alias("e")).select("lang", "value", "e.number", "e.other")
    name, item = groups.select("lang", "number", "source"), groups.select("lang", F.col("number").alias("other"), F.col("source").alias("item"))
    pairs = pairs.join(name, ["lang", "number"]).join(item, ["lang", "other"]).select("lang", "source", F.lit("pair").alias("part"), "item", "value")

    own = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    q = share(F.col("total"), F.col("lang_whole"))
    terms = shares.filter("count > 0").withColumn("q", q).filter("p > q")
    terms = terms.select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), divergence(F.col("p"), F.col("q")).alias("value"))
    top = terms.withColumn("rank", F.row_number().over(own)).filter(F.col("rank") <= top_terms)
    return pairs.withColumn("rank", F.row_number().over(own)).unionByName(top).withColumn("value", F.col("value").cast("long"))
