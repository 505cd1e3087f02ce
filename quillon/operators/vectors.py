"""Vectors: normal form, cosine pairs above a threshold, ranks.

All-pairs work is done block against block: rows are dealt, near ones together, to
blocks of a bounded size and packed to one binary matrix each before they are copied,
each pair of blocks that can hold a wanted pair meets in one task, and only pairs that
pass (or each query's best of a tile) leave it. Exact, with memory bounded by the block, and the same for a
self-join and for two sides.
"""

from __future__ import annotations

import hashlib
import math
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillon.functions.text import word_tokens
from quillon.plans.staging import stage

BLOCK_BYTES, TILE_ROWS, LEAST_ROWS, PIVOTS = 16 << 20, 4096, 256, 64


def norm(v: Column) -> Column:
    return F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x * x))


def normalize(v: Column) -> Column:
    """The vector at length one; null where it is empty, zero or not finite."""
    wide = v.cast("array<double>")
    fine = F.forall(wide, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    length = norm(wide)
    return F.when((F.size(wide) > 0) & fine & (length > 0), F.transform(wide, lambda x: x / length))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """Score of unit vectors, clipped to -1 to 1; null where either is null."""
    score = dot(a, b)
    return F.when(score > 1.0, 1.0).when(score < -1.0, -1.0).otherwise(score)


def unit_vectors(rows: DataFrame, id_column: str, vector_column: str) -> DataFrame:
    return rows.select(F.col(id_column).alias("id"), normalize(F.col(vector_column)).alias("v")).filter("v IS NOT NULL")


def _reachable(a: np.ndarray, a_angles: np.ndarray, b: np.ndarray, b_angles: np.ndarray, threshold: float | None) -> np.ndarray:
    """Whether vectors of two caps, by row and by column, can have a cosine of ``threshold``."""
    if threshold is None:
        return np.ones((len(a), len(b)), bool)
    between = np.arccos(np.clip(a @ b.T, -1.0, 1.0))
    least = np.maximum(0.0, between - a_angles[:, None] - b_angles[None, :])
    return np.cos(least) >= threshold - 1e-6


@dataclass(frozen=True)
class Blocks:
    """Vectors packed for all-pairs work: staged ``block, ids, tags, m, centre, angle``, one row a block.

    ``caps`` has each block's number, centre and largest angle from it; two vectors of
    two blocks cannot be closer than what their caps leave between them.
    """

    rows: DataFrame
    source: DataFrame
    numbers: np.ndarray
    centres: np.ndarray
    angles: np.ndarray

    def skipped(self, other: Blocks | None, threshold: float) -> tuple[int, int]:
        """How many pairs of blocks the caps rule out, and how many there are."""
        right = self if other is None else other
        fits = _reachable(self.centres, self.angles, right.centres, right.angles, threshold)
        pairs = np.triu(np.ones_like(fits)) if other is None else np.ones_like(fits)
        return int((~fits & pairs).sum()), int(pairs.sum())

    def partners(self, threshold: float | None, side: int):
        """A column function: the blocks of this side that a block of the other side meets.

        ``side`` 1 or -1 keeps later or earlier ones and itself, 0 all.
        """
        numbers, centres, angles = self.numbers, self.centres, self.angles

        @F.pandas_udf("array<int>")
        def of(block: pd.Series, centre: pd.Series, angle: pd.Series) -> pd.Series:
            fits = (numbers[None, :] - block.to_numpy()[:, None]) * side >= 0
            if len(numbers):
                fits &= _reachable(np.array(centre.tolist(), float), angle.to_numpy(float), centres, angles, threshold)
            return pd.Series([numbers[row].tolist() for row in fits])

        return of


def _near_pivots(rows: DataFrame) -> DataFrame:
    """``rows (id, v)`` with a ``key`` that orders them by their nearest pivot and their closeness to it.

    The pivots are a bounded sample, by hash of the id, each numbered after the one
    that is nearest to it of those left.
    """
    few = rows.select("v").orderBy(F.xxhash64("id")).limit(PIVOTS).collect()
    left = np.array([r.v for r in few], float)
    chain, left = [left[0]], left[1:]
    while len(left):
        nearest = int((left @ chain[-1]).argmax())
        chain.append(left[nearest])
        left = np.delete(left, nearest, axis=0)
    pivots = np.array(chain).T

    @F.pandas_udf("double")
    def of(v: pd.Series) -> pd.Series:
        scores = np.array(v.tolist(), float) @ pivots
        return pd.Series(scores.argmax(axis=1) + 0.49 * (1 + np.clip(scores.max(axis=1), -1, 1)))

    jitter = F.pmod(F.xxhash64("id"), F.lit(1 << 20)) / float(1 << 40)  # parts equal vectors
    return rows.withColumn("key", of("v") + jitter)


def pack(rows: DataFrame | Blocks, block_rows: int | None = None) -> Blocks:
    """``rows (id, v)``, with a long ``tag`` or without, dealt to blocks of vectors that lie near each other, one matrix each.

    Vectors go by quantile of their nearest pivot and their closeness to it, equal ones by
    the hash of their id. A block has about ``BLOCK_BYTES`` of numbers and at most twice
    that, or fewer where there would not be pairs of blocks for all cores. The table is
    staged: how rows are dealt does not matter, but every reader must see the same
    blocks. The driver holds a centre for each block.
    """
    if isinstance(rows, Blocks):
        return rows
    kind, cores = dict(rows.dtypes)["id"], rows.sparkSession.sparkContext.defaultParallelism
    tag = F.coalesce("tag", F.lit(0).cast("long")) if "tag" in rows.columns else F.lit(0).cast("long")
    plain = rows.select("id", F.col("v").cast("array<double>").alias("v"), tag.alias("tag"))
    rows = plain if hasattr(rows, "staged_path") else stage(plain, "vectors")
    size = rows.agg(F.count("*").alias("n"), F.coalesce(F.max(F.size("v")), F.lit(1)).alias("width")).first()
    wanted = min(math.ceil(math.sqrt(2 * cores)), -(-size.n // LEAST_ROWS))
    blocks = max(1, -(-size.n // block_rows) if block_rows else max(-(-size.n * size.width * 8 // BLOCK_BYTES), wanted))
    most = 2 * -(-size.n // blocks)

    def packed(key: tuple, group: pa.Table) -> pa.Table:
        group = group.combine_chunks()
        ids, matrix = group.column("id").chunk(0), group.column("v").chunk(0).flatten().to_numpy(zero_copy_only=False).reshape(-1, size.width)
        tags = np.ascontiguousarray(group.column("tag").to_numpy(), "<i8")
        out: dict[str, list] = {"block": [], "ids": [], "tags": [], "m": [], "centre": [], "angle": []}
        for k, at in enumerate(range(0, len(ids), most)):
            part = np.ascontiguousarray(matrix[at : at + most], "<f8")
            centre = part.mean(axis=0)
            length = np.sqrt(centre @ centre)
            centre = centre / length if length > 0 else centre
            angle = float(np.arccos(np.clip(part @ centre, -1.0, 1.0)).max()) if length > 0 else math.pi
            for name, value in zip(out, (key[0].as_py() * 1024 + k, ids.slice(at, most).to_pylist(), tags[at : at + most].tobytes(), part.tobytes(), centre.tolist(), angle), strict=True):
                out[name].append(value)
        kinds = [pa.int32(), pa.list_(ids.type), pa.binary(), pa.binary(), pa.list_(pa.float64()), pa.float64()]
        return pa.table({name: pa.array(values, kind) for (name, values), kind in zip(out.items(), kinds, strict=True)})

    schema = f"block int, ids array<{kind}>, tags binary, m binary, centre array<double>, angle double"
    if not size.n:
        made = stage(rows.sparkSession.createDataFrame([], schema), "blocks")
    else:
        keyed = _near_pivots(rows)
        shares = [k / blocks for k in range(1, blocks)]
        cuts = np.array(keyed.agg(F.percentile_approx("key", shares, 100 * blocks)).first()[0] if shares else [], float)
        dealt = keyed.withColumn("deal", F.pandas_udf(lambda key: pd.Series(np.searchsorted(cuts, key.to_numpy())), "int")("key"))
        made = stage(dealt.select("deal", "id", "v", "tag").groupBy("deal").applyInArrow(packed, schema), "blocks")
    caps = made.select("block", "centre", "angle").orderBy("block").collect()
    centres = np.array([r.centre for r in caps], float).reshape(len(caps), -1 if caps else 0)
    return Blocks(made, rows, np.array([r.block for r in caps], np.int64), centres, np.array([r.angle for r in caps], float))


def _no_ids(kind: str) -> np.ndarray:
    """An empty column of ids, typed: Arrow cannot tell the type of an empty list."""
    return np.zeros(0, object if kind == "string" else np.int64)


def _met(left: DataFrame | Blocks, right: DataFrame | Blocks, same: bool, work, schema: str, block_rows: int | None, threshold: float | None = None, tagged: bool = False, condense=None) -> DataFrame:
    """``work(left ids, left matrix, right ids, right matrix)`` for every pair of blocks; where ``tagged`` both sides' tags follow.

    A pair of blocks is one task's group of two rows; within it tiles bound the
    memory of the scores. With itself a block meets each pair of its tiles once.
    ``condense`` cuts what the tiles of some left rows have given so far, after each tile.
    Pairs of blocks whose caps leave no cosine of ``threshold`` never meet.
    """
    a = pack(left, block_rows)
    b = a if same else pack(right, block_rows)
    ends = ("block", "centre", "angle")
    left, right = b.partners(threshold, 1 if same else 0)(*ends), a.partners(threshold, -1 if same else 0)(*ends)
    a = a.rows.select(F.col("block").alias("al"), F.explode(left).alias("ar"), F.col("ids").alias("a_ids"), F.col("m").alias("a_m"), *([F.col("tags").alias("a_tags")] if tagged else []))
    b = b.rows.select(F.col("block").alias("br"), F.explode(right).alias("bl"), F.col("ids").alias("b_ids"), F.col("m").alias("b_m"), *([F.col("tags").alias("b_tags")] if tagged else []))
    b = b.toDF(*b.columns)

    def matrix(row: pd.DataFrame, side: str) -> tuple[np.ndarray, np.ndarray]:
        ids = np.asarray(row[f"{side}_ids"].iloc[0])
        return ids, np.frombuffer(row[f"{side}_m"].iloc[0], "<f8").reshape(len(ids), -1)

    def meet(x: pd.DataFrame, y: pd.DataFrame) -> pd.DataFrame:
        none, no_tags = (np.array([], object), np.zeros((0, 1))), [np.zeros(0, "<i8")] * 2 if tagged else []
        if x.empty or y.empty:
            return work(*none, *none, *no_tags)
        (li, lv), (ri, rv), out = matrix(x, "a"), matrix(y, "b"), []
        itself = same and x["al"].iloc[0] == x["ar"].iloc[0]
        tags = [np.frombuffer(row[f"{side}_tags"].iloc[0], "<i8") for row, side in ((x, "a"), (y, "b"))] if tagged else []
        for p in range(0, len(li), TILE_ROWS):
            rows = []
            for q in range(p if itself else 0, len(ri), TILE_ROWS):
                own = [part[at : at + TILE_ROWS] for part, at in zip(tags, (p, q), strict=False)]
                rows.append(work(li[p : p + TILE_ROWS], lv[p : p + TILE_ROWS], ri[q : q + TILE_ROWS], rv[q : q + TILE_ROWS], *own))
                if condense is not None and len(rows) > 1:
                    rows = [condense(pd.concat(rows, ignore_index=True))]
            out += rows
        return pd.concat(out, ignore_index=True)

    return a.groupBy("al", "ar").cogroup(b.groupBy("bl", "br")).applyInPandas(meet, schema)


def pairs_above(left: DataFrame | Blocks, right: DataFrame | Blocks | None, threshold: float, block_rows: int | None = None) -> DataFrame:
    """``left_id, right_id, score`` with cosine >= ``threshold``.

    Without ``right`` a self-join with left_id < right_id; else every pair of
    different ids.
    """
    same = right is None
    left = pack(left, block_rows)
    kind = dict(left.source.dtypes)["id"]

    def work(li, lv, ri, rv) -> pd.DataFrame:
        if not len(li) or not len(ri):
            return pd.DataFrame({"left_id": _no_ids(kind), "right_id": _no_ids(kind), "score": np.zeros(0)})
        scores = np.clip(lv @ rv.T, -1.0, 1.0)
        i, j = np.nonzero(scores >= threshold)
        out = pd.DataFrame({"left_id": li[i], "right_id": ri[j], "score": scores[i, j]})
        out = out[out.left_id != out.right_id]
        if same:
            turn = out.left_id > out.right_id
            out.loc[turn, ["left_id", "right_id"]] = out.loc[turn, ["right_id", "left_id"]].to_numpy()
            out = out.drop_duplicates(["left_id", "right_id"])
        return out

    return _met(left, left if same else right, same, work, f"left_id {kind}, right_id {kind}, score double", block_rows, threshold)


CHUNK_ROWS, SAME_SCORE = 512, 1.5e-6  # scores that are equal at six digits lie within


def _best(i: np.ndarray, scores: np.ndarray, below: np.ndarray, ids: np.ndarray, best: int) -> np.ndarray:
    """Places of the ``best`` first entries by (score at six digits down, id) of each row and side of the threshold, or a few more."""
    if not len(i):
        return np.zeros(0, np.int64)
    group = 2 * i + below
    order = np.lexsort((-scores, group))
    starts = np.flatnonzero(np.r_[True, np.diff(group[order]) != 0])
    sizes = np.diff(np.r_[starts, len(order)])
    edge = scores[order][starts + np.minimum(best, sizes) - 1] - SAME_SCORE
    order = order[scores[order] >= np.repeat(edge, sizes)]
    if sizes.max(initial=0) > best:  # of equal scores, as copies have them, only the first ids can be among the best
        some = pd.DataFrame({"at": order, "group": group[order], "score": np.round(scores[order], 12), "id": ids[order]}).sort_values("id", kind="stable")
        order = some["at"].to_numpy()[(some.groupby(["group", "score"]).cumcount() < best).to_numpy()]
    return order


def admissible_pairs(left: DataFrame | Blocks, right: DataFrame | Blocks | None, threshold: float, alike: float, best: int | None = None, block_rows: int | None = None) -> DataFrame:
    """``left_id, right_id, score, alike`` with cosine >= ``threshold``, or >= ``alike`` where both have the same
    ``tag`` (0: none), as ``alike`` tells.

    With ``best`` a left row keeps, of either kind, those that can be among its first
    ``best`` by (score at six digits down, right id) only, of all that its block meets in
    a task. The rest of the pairs never leaves a tile. Without ``right`` a self-join with left_id < right_id, as ``pairs_above``.
    """
    same, least = right is None, min(threshold, alike)
    left = pack(left, block_rows)
    kind = dict(left.source.dtypes)["id"]

    def work(li, lv, ri, rv, lt, rt) -> pd.DataFrame:
        found = [(_no_ids(kind), _no_ids(kind), np.zeros(0), np.zeros(0, bool))]
        for at in range(0, len(li) if len(ri) else 0, CHUNK_ROWS):
            scores = lv[at : at + CHUNK_ROWS] @ rv.T
            i, j = np.nonzero(scores >= (least if least > -1.0 else -np.inf))
            s = np.clip(scores[i, j], -1.0, 1.0)
            i += at
            keep = (s >= threshold) | ((lt[i] == rt[j]) & (lt[i] != 0))
            i, j, s = i[keep], j[keep], s[keep]
            keep = li[i] != ri[j]
            i, j, s = i[keep], j[keep], s[keep]
            if best is not None:
                keep = _best(i, s, s < threshold, ri[j], best)
                i, j, s = i[keep], j[keep], s[keep]
            found.append((li[i], ri[j], s, (lt[i] == rt[j]) & (lt[i] != 0)))
        a, b, s, t = (np.concatenate(part) for part in zip(*found, strict=True))
        out = pd.DataFrame({"left_id": a, "right_id": b, "score": s, "alike": t})
        if same:
            turn = out.left_id > out.right_id
            out.loc[turn, ["left_id", "right_id"]] = out.loc[turn, ["right_id", "left_id"]].to_numpy()
            out = out.drop_duplicates(["left_id", "right_id"])
        return out

    def condense(rows: pd.DataFrame) -> pd.DataFrame:
        scores = rows["score"].to_numpy()
        return rows.iloc[np.sort(_best(rows.groupby("left_id", sort=False).ngroup().to_numpy(), scores, scores < threshold, rows["right_id"].to_numpy(), best))]

    few = condense if best is not None and not same else None
    return _met(left, left if same else right, same, work, f"left_id {kind}, right_id {kind}, score double, alike boolean", block_rows, least, tagged=True, condense=few)


def top_ranks(queries: DataFrame | Blocks, candidates: DataFrame | Blocks, limit: int, block_rows: int | None = None) -> DataFrame:
    """``query_id, candidate_id, score, rank``: each query's best, by (score down, id).

    Each block keeps a query's ``limit`` best (ties at the edge included), so the
    last ranking sees at most that many for each block.
    """
    queries = pack(queries, block_rows)
    kind = dict(queries.source.dtypes)["id"]

    def work(qi, qv, ci, cv) -> pd.DataFrame:
        if not len(qi) or not len(ci):
            return pd.DataFrame({"query_id": _no_ids(kind), "candidate_id": _no_ids(kind), "score": np.zeros(0)})
        scores = np.clip(qv @ cv.T, -1.0, 1.0)
        scores = np.where(qi[:, None] == ci[None, :], -np.inf, scores)
        if limit < scores.shape[1]:
            edge = -np.partition(-scores, limit - 1, axis=1)[:, limit - 1 : limit]
            keep = scores >= edge - 1e-12
        else:
            keep = np.ones_like(scores, bool)
        i, j = np.nonzero(keep & np.isfinite(scores))
        return pd.DataFrame({"query_id": qi[i], "candidate_id": ci[j], "score": scores[i, j]})

    def condense(rows: pd.DataFrame) -> pd.DataFrame:
        return rows[rows.groupby("query_id", sort=False)["score"].rank(method="min", ascending=False) <= limit]

    few = condense if limit < TILE_ROWS else None
    near = _met(queries, candidates, False, work, f"query_id {kind}, candidate_id {kind}, score double", block_rows, condense=few)
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "candidate_id")
    return near.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= limit)


def _slots(buckets: int):
    """Bucket and sign of words, by their BLAKE2b digest of 16 bytes."""

    @F.pandas_udf("struct<k:int,sign:double>")
    def of(words: pd.Series) -> pd.DataFrame:
        memo: dict[str, tuple[int, float]] = {}
        for word in words.unique():
            digest = hashlib.blake2b(word.encode(), digest_size=16).digest()
            memo[word] = int.from_bytes(digest[:8], "big") % buckets, 1.0 if digest[8] & 1 else -1.0
        return pd.DataFrame([memo[w] for w in words], columns=["k", "sign"])

    return of


def hashing_vectors(texts: DataFrame, buckets: int = 64) -> DataFrame:
    """``id, v``: unit vectors of signed word counts of ``texts (id, text)``.

    Words are counted before they are hashed and summed by bucket before a vector
    is made, so a long text gives at most ``buckets`` rows. Where all cancels, or
    there is no word, the first bucket is 1.
    """
    if buckets < 2:
        raise ValueError("there must be two buckets or more")
    counts = texts.select("id", F.explode(word_tokens(F.col("text"))).alias("w")).groupBy("id", "w").agg(F.count("*").alias("n"))
    slots = counts.withColumn("s", _slots(buckets)("w")).groupBy("id", "s.k").agg(F.sum(F.col("n") * F.col("s.sign")).alias("x"))
    found = slots.groupBy("id").agg(F.map_from_entries(F.collect_list(F.struct("k", "x"))).alias("m"))
    filled = F.transform(F.sequence(F.lit(0), F.lit(buckets - 1)), lambda k: F.coalesce(F.try_element_at("m", k), F.lit(0.0)))
    first = F.transform(F.sequence(F.lit(0), F.lit(buckets - 1)), lambda k: F.when(k == 0, 1.0).otherwise(0.0))
    rows = found.select("id", filled.alias("e")).withColumn("e", F.when(F.forall("e", lambda x: x == 0), first).otherwise(F.col("e")))
    return unit_vectors(rows, "id", "e")


def scored(pairs: DataFrame, vectors: DataFrame) -> DataFrame:
    """Pairs with the score of their vectors; both ids must have one."""
    a = vectors.select(F.col("id").alias("left_id"), F.col("v").alias("lv"))
    b = vectors.select(F.col("id").alias("right_id"), F.col("v").alias("rv"))
    joined = pairs.join(a, "left_id", "left").join(b, "right_id", "left")
    missing = F.coalesce(F.when(F.col("lv").isNull(), F.col("left_id")), F.when(F.col("rv").isNull(), F.col("right_id")))
    guard = F.when(missing.isNotNull(), F.raise_error(F.concat(F.lit("missing vector for "), missing.cast("string"))).cast("double"))
    return joined.withColumn("score", F.coalesce(guard, cosine(F.col("lv"), F.col("rv")))).drop("lv", "rv")


def score_sums(members: DataFrame, others: DataFrame) -> DataFrame:
    """``id, total``: the sum of each member's scores to all others.

    By linearity this is one dot product with the sum of the other vectors, so
    nothing pairwise is made (unit vectors: no score needs clipping).
    """
    whole = others.select(F.posexplode("v").alias("k", "x")).groupBy("k").agg(F.sum("x").alias("x"))
    total = whole.agg(F.array_sort(F.collect_list(F.struct("k", "x"))).alias("parts")).select(F.transform("parts", lambda p: p["x"]).alias("w"))
    return members.crossJoin(F.broadcast(total)).select("id", dot(F.col("v"), F.col("w")).alias("total"))


def multi_view_pairs(views: DataFrame, threshold: float, block_rows: int | None = None) -> DataFrame:
    """Best score of each pair over the channels of ``views (id, channel, v)`` that both have.

    A record's channels stand side by side in one row of a block, zeros where it has
    none, and the tile takes the best of them: one pass for all channels.
    """
    sizes = views.groupBy("channel").agg(F.max(F.size("v")).alias("width")).orderBy("channel").collect()
    kind = dict(views.dtypes)["id"]
    by = views.groupBy("id").agg(F.map_from_entries(F.collect_list(F.struct("channel", "v"))).alias("c"))
    zeros = lambda n: F.array_repeat(F.lit(0.0), n)
    beside = F.concat(F.array().cast("array<double>"), *[F.coalesce(F.try_element_at("c", F.lit(r.channel)).cast("array<double>"), zeros(r.width)) for r in sizes])
    edges = np.cumsum([0, *(r.width for r in sizes)])

    def work(li, lv, ri, rv) -> pd.DataFrame:
        if not len(li) or not len(ri):
            return pd.DataFrame({"left_id": _no_ids(kind), "right_id": _no_ids(kind), "score": np.zeros(0)})
        best = np.full((len(li), len(ri)), -np.inf)
        for lo, hi in zip(edges, edges[1:], strict=False):
            a, b = lv[:, lo:hi], rv[:, lo:hi]
            own, other = np.flatnonzero(a.any(axis=1)), np.flatnonzero(b.any(axis=1))
            scores = np.clip(a[own] @ b[other].T, -1.0, 1.0)
            best[np.ix_(own, other)] = np.maximum(best[np.ix_(own, other)], scores)
        i, j = np.nonzero(best >= threshold)
        turn = li[i] > ri[j]
        out = pd.DataFrame({"left_id": np.where(turn, ri[j], li[i]), "right_id": np.where(turn, li[i], ri[j]), "score": best[i, j]})
        return out[out.left_id != out.right_id].drop_duplicates(["left_id", "right_id"])

    rows = by.select("id", beside.alias("v"))
    return _met(rows, rows, True, work, f"left_id {kind}, right_id {kind}, score double", block_rows)


def _with_lists(pairs: DataFrame, queries: Blocks, targets: Blocks | None, *values: str) -> DataFrame:
    """``queries``' blocks with what is asked of them, one list a block (and block of ``targets``): places of the queries, and of the targets or their ``values``."""
    place = lambda blocks, key, n: blocks.rows.select(F.col("block").alias(f"b{n}"), F.posexplode("ids").alias(f"i{n}", key))
    rows, keys = pairs.join(place(queries, "query_id", 0), "query_id"), ["b0"]
    if targets is not None:
        rows, keys, values = rows.join(place(targets, "target_id", 1), "target_id"), ["b0", "b1"], ("i1",)
    lists = rows.groupBy(*keys).agg(F.collect_list(F.struct("i0", *values)).alias("asked"))
    lists = lists.select(*keys, *[F.col(f"asked.{c}").alias(c) for c in ("i0", *values)])
    return lists.join(queries.rows.select(F.col("block").alias("b0"), F.col("ids").alias("a_ids"), F.col("m").alias("a_m")), "b0")


def _matrix(row: pd.DataFrame, side: str) -> tuple[np.ndarray, np.ndarray]:
    ids = np.asarray(row[f"{side}_ids"].iloc[0])
    return ids, np.frombuffer(row[f"{side}_m"].iloc[0], "<f8").reshape(len(ids), -1)


def pair_scores(pairs: DataFrame, queries: DataFrame | Blocks, targets: DataFrame | Blocks) -> DataFrame:
    """``query_id, target_id, score`` of distinct ``pairs (query_id, target_id)`` whose ids have vectors.

    Blocks meet as in all-pairs work, with the places of the pairs that are asked for, so
    a vector is copied for each block that it meets and not for each pair.
    """
    queries, targets = pack(queries), pack(targets)
    a = _with_lists(pairs.select("query_id", "target_id").distinct(), queries, targets)
    met = F.array(*map(F.lit, queries.numbers.tolist())).cast("array<int>")
    b = targets.rows.select(F.explode(met).alias("b2"), F.col("block").alias("b3"), F.col("ids").alias("b_ids"), F.col("m").alias("b_m"))
    kind = dict(queries.source.dtypes)["id"]

    def meet(x: pd.DataFrame, y: pd.DataFrame) -> pd.DataFrame:
        if x.empty or y.empty:
            return pd.DataFrame({"query_id": _no_ids(kind), "target_id": _no_ids(kind), "score": np.zeros(0)})
        (qi, qv), (ti, tv), i, j = _matrix(x, "a"), _matrix(y, "b"), np.asarray(x["i0"].iloc[0]), np.asarray(x["i1"].iloc[0])
        parts = [np.einsum("ij,ij->i", qv[i[k : k + TILE_ROWS]], tv[j[k : k + TILE_ROWS]]) for k in range(0, len(i), TILE_ROWS)]
        return pd.DataFrame({"query_id": qi[i], "target_id": ti[j], "score": np.clip(np.concatenate(parts), -1.0, 1.0)})

    return a.groupBy("b0", "b1").cogroup(b.groupBy("b2", "b3")).applyInPandas(meet, f"query_id {kind}, target_id {kind}, score double")


HALF = 5e-13  # scores within are equal at twelve digits


def pair_ranks(pairs: DataFrame, vectors: DataFrame | Blocks, pool: DataFrame | Blocks) -> DataFrame:
    """``query_id, target_id, score, rank``: where each target stands in the query's ranking of ``pool``.

    A rank is one more than the members that come before the target, by (score
    down, id), the query itself left out; the target need not be in the pool. Pairs with
    a ``score`` are taken as they are, and ``vectors`` need have the queries only. A
    query's scores to a block are sorted once for all of its targets, and each block yields
    one count for a pair, so the full rankings are never made.
    """
    if "score" not in pairs.columns:
        vectors = pack(vectors)
        pairs = stage(pair_scores(pairs, vectors, vectors), "pair-scores")
    queries, pool = pack(vectors), pack(pool)
    kind = dict(queries.source.dtypes)["id"]
    met = F.array(*map(F.lit, pool.numbers.tolist())).cast("array<int>")
    a = _with_lists(pairs, queries, None, "target_id", "score").withColumn("b1", F.explode(met))
    back = F.array(*map(F.lit, queries.numbers.tolist())).cast("array<int>")
    b = pool.rows.select(F.explode(back).alias("b2"), F.col("block").alias("b3"), F.col("ids").alias("b_ids"), F.col("m").alias("b_m"))

    def meet(x: pd.DataFrame, y: pd.DataFrame) -> pd.DataFrame:
        if x.empty or y.empty:
            return pd.DataFrame({"query_id": _no_ids(kind), "target_id": _no_ids(kind), "score": np.zeros(0), "ahead": np.zeros(0, np.int64)})
        (qi, qv), (pi, pv) = _matrix(x, "a"), _matrix(y, "b")
        i = np.asarray(x["i0"].iloc[0])
        order = np.argsort(i, kind="stable")
        i, targets, score = i[order], np.asarray(x["target_id"].iloc[0])[order], np.asarray(x["score"].iloc[0], float)[order]
        ahead, asked = np.zeros(len(i), np.int64), np.unique(i)
        for at in range(0, len(asked), 64):
            some = asked[at : at + 64]
            scores = np.clip(qv[some] @ pv.T, -1.0, 1.0)
            scores[qi[some][:, None] == pi[None, :]] = -np.inf
            for row, (lo, hi) in enumerate(zip(np.searchsorted(i, some, "left"), np.searchsorted(i, some, "right"), strict=True)):
                by = np.argsort(scores[row])
                own, wanted = scores[row][by], score[lo:hi]
                first, last = np.searchsorted(own, wanted - HALF, "left"), np.searchsorted(own, wanted + HALF, "right")
                ahead[lo:hi] = len(own) - last
                for k in np.flatnonzero(last > first):  # equals, of which the target is one as a rule
                    ahead[lo + k] += np.count_nonzero(pi[by[first[k] : last[k]]] < targets[lo + k])
        return pd.DataFrame({"query_id": qi[i], "target_id": targets, "score": score, "ahead": ahead})

    counts = a.groupBy("b0", "b1").cogroup(b.groupBy("b2", "b3")).applyInPandas(meet, f"query_id {kind}, target_id {kind}, score double, ahead long")
    if not len(pool.numbers):
        counts = pairs.select("query_id", "target_id", "score", F.lit(0).cast("long").alias("ahead"))
    rows = counts.groupBy("query_id", "target_id").agg(F.max("score").alias("score"), F.sum("ahead").alias("ahead"))
    return rows.select("query_id", "target_id", "score", (F.col("ahead") + 1).alias("rank"))
