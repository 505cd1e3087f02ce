"""Approximate nearest neighbours by randomly rotated one-bit codes.

A vector's residual from the centre is padded with zeros to the code length, turned by
a random rotation and cut to its signs: x = signs / sqrt(bits). With the residual's
length and the correction scalar a = <x, o> of its direction o, a query's direction q has

    <o, q>  is about  <x, q> / a,   off by  sqrt(1 - a^2) / a * |e . q|

where e is a random direction for the rotation, so that e . q is about a normal number
of spread 1 / sqrt(bits - 1). ``SIGMAS`` of them bound each squared distance from both
sides. The codes are read twice: first for the ``FIRST`` times k rows that each query is
estimated to have nearest, of whose true distances the k-th bounds its k nearest; then
for every row whose lower bound is within it. These are reranked by the distance of the
original vectors; a true neighbour is lost only where its own error passes the bound.

The centre comes from a sample of about ``SAMPLE_ROWS`` vectors, at most so many of each
length; all vectors are coded. Of equal vectors only the first k + 1 by id can be among
anyone's k nearest, so only these are searched, and equal queries are searched once: a
vector that a third of all rows share is no work of its own. Codes move instead of
vectors, one copy for each block of queries. Vectors of different lengths are never
compared.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillon.plans.staging import stage

K = 10
BITS = 1024  # codes are at least so long, whatever the vectors' length
SIGMAS = 3.0
FIRST = 4  # times k: how many of the best estimates are measured for a query's bound
SEED = 42
SAMPLE_ROWS, SAMPLE_NUMBERS = 4096, 4_000_000
RUN_ROWS = 1 << 16  # codes of a task
QUERY_NUMBERS = 1 << 20  # numbers in a task's block of queries
TILE_CODES, TILE_QUERIES = 4096, 256


def usable(vector: Column) -> Column:
    """Not null, all components finite, at least one of them not zero."""
    number = F.lit(float("inf"))
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < number))
    return F.coalesce(finite & F.exists(vector, lambda x: x != 0), F.lit(False))


def code_bits(dim: int) -> int:
    return max(BITS, -(-dim // 64) * 64)


@lru_cache(maxsize=8)
def rotation(dim: int) -> np.ndarray:
    """The first ``dim`` rows of a random rotation of the code's space: zeros need no more."""
    rng = np.random.default_rng((SEED, dim))
    turned, upper = np.linalg.qr(rng.standard_normal((code_bits(dim), dim)))
    return (turned * np.sign(np.diag(upper))).T.copy()


def matrix(column: pa.Array, dim: int) -> np.ndarray:
    return np.asarray(column.flatten(), np.float64).reshape(-1, dim)


def encode(vectors: np.ndarray, centre: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Packed signs, residual lengths and correction scalars (0 for the centre itself)."""
    with np.errstate(over="ignore", invalid="ignore", divide="ignore"):
        rest = vectors - centre
        length = np.sqrt((rest * rest).sum(axis=1))
        turned = rest @ rotation(vectors.shape[1])
        signs = turned > 0
        scalar = np.abs(turned).sum(axis=1) / (length * np.sqrt(turned.shape[1]))
    return np.packbits(signs, axis=1), length, np.where(np.isfinite(scalar), scalar, 0.0)


def centres(vectors: DataFrame) -> dict[int, np.ndarray]:
    """The mean of a bounded sample of the vectors of each length."""
    grain = 1 << 20
    share = min(grain, -(-2 * SAMPLE_ROWS * grain // max(1, vectors.count())))
    some = vectors.select("dim", "row", "vector").filter(F.pmod(F.xxhash64("row"), F.lit(grain)) < share)
    within = Window.partitionBy("dim").orderBy(F.xxhash64("row"), "row")
    ranked = some.withColumn("at", F.row_number().over(within)).filter(F.col("at") <= SAMPLE_ROWS)
    ranked = ranked.filter((F.col("at") == 1) | (F.col("at") * F.col("dim") <= SAMPLE_NUMBERS))
    means = {}
    for dim, part in ranked.select("dim", "vector").toPandas().groupby("dim"):
        with np.errstate(over="ignore"):
            means[dim] = np.nan_to_num(np.array(part["vector"].tolist(), np.float64).mean(axis=0), posinf=0.0, neginf=0.0)
    return means


class Search:
    """One block of queries against one run of codes."""

    def __init__(self, queries: np.ndarray, centre: np.ndarray) -> None:
        with np.errstate(over="ignore", invalid="ignore", divide="ignore"):
            rest = queries - centre
            self.length = np.sqrt((rest * rest).sum(axis=1))
            unit = np.nan_to_num(rest / self.length[:, None])
        self.turned = (unit @ rotation(queries.shape[1])).astype(np.float32)
        self.bits = self.turned.shape[1]

    def estimates(self, part: slice, codes: np.ndarray, length: np.ndarray, scalar: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Estimated squared distances, queries by codes, and their lower bounds."""
        signs = np.unpackbits(codes, axis=1).astype(np.float32) * 2 - 1
        own = self.length[part, None]
        with np.errstate(over="ignore", invalid="ignore", divide="ignore"):
            inner = (self.turned[part] @ signs.T) / np.sqrt(self.bits) / scalar
            error = np.sqrt(np.maximum(0, 1 - scalar * scalar)) / scalar * (SIGMAS / np.sqrt(self.bits - 1)) + 1e-5
            sizes, both = own**2 + length[None, :] ** 2, 2 * own * length[None, :]
            middle = sizes - both * inner
            lower = np.maximum(middle - both * error, (own - length[None, :]) ** 2) - 1e-9 * sizes
        return np.where(np.isfinite(middle), middle, np.inf), np.where(np.isfinite(lower), lower, -np.inf)

    def _tiles(self, codes: np.ndarray, length: np.ndarray, scalar: np.ndarray):
        for q in range(0, len(self.length), TILE_QUERIES):
            for at in range(0, len(length), TILE_CODES):
                tile = slice(at, at + TILE_CODES)
                yield q, at, *self.estimates(slice(q, q + TILE_QUERIES), codes[tile], length[tile], scalar[tile])

    def best(self, codes: np.ndarray, length: np.ndarray, scalar: np.ndarray, k: int) -> tuple[np.ndarray, ...]:
        """``query, code, estimate`` of the k codes that each query is estimated to have nearest."""
        value = np.full((len(self.length), k), np.inf)
        code = np.full((len(self.length), k), -1)
        for q, at, middle, _ in self._tiles(codes, length, scalar):
            part = slice(q, q + len(middle))
            few = np.argpartition(middle, min(k, middle.shape[1]) - 1, axis=1)[:, :k]
            values = np.concatenate([value[part], np.take_along_axis(middle, few, axis=1)], axis=1)
            order = np.argsort(values, axis=1, kind="stable")[:, :k]
            value[part] = np.take_along_axis(values, order, axis=1)
            code[part] = np.take_along_axis(np.concatenate([code[part], few + at], axis=1), order, axis=1)
        i, j = np.nonzero(code >= 0)
        return i, code[i, j], value[i, j]

    def within(self, codes: np.ndarray, length: np.ndarray, scalar: np.ndarray, bound: np.ndarray) -> tuple[np.ndarray, ...]:
        """``query, code`` of the pairs whose lower bound is within the query's bound."""
        queries, found = [np.zeros(0, int)], [np.zeros(0, int)]
        for q, at, _, lower in self._tiles(codes, length, scalar):
            i, j = np.nonzero(lower <= bound[q : q + len(lower), None])
            queries.append(i + q)
            found.append(j + at)
        return np.concatenate(queries), np.concatenate(found)


def coded(vectors: DataFrame, means: dict[int, np.ndarray]) -> DataFrame:
    """``dim, row, code, length, scalar`` of every vector."""

    def run(batches):
        for batch in batches:
            dims = batch.column("dim").to_numpy()
            for dim in np.unique(dims).tolist():
                own = batch.filter(pa.array(dims == dim))
                centre = means.get(dim, np.zeros(dim))
                codes, length, scalar = encode(matrix(own.column("vector"), dim), centre)
                columns = [own.column("dim"), own.column("row"), pa.array([c.tobytes() for c in codes], pa.binary()), pa.array(length), pa.array(scalar)]
                yield pa.RecordBatch.from_arrays(columns, ["dim", "row", "code", "length", "scalar"])

    return vectors.select("dim", "row", "vector").mapInArrow(run, "dim int, row long, code binary, length double, scalar double")


def distance(a: Column, b: Column) -> Column:
    """Euclidean distance in double precision, summed from the first component on."""
    squares = F.zip_with(a, b, lambda x, y: (x - y) * (x - y))
    return F.sqrt(F.aggregate(squares, F.lit(0.0), lambda s, x: s + x))


class Index:
    """The codes of ``vectors (dim, row, vector)``, searched in blocks of queries and runs of codes.

    A task has one block of queries and one run of codes, both of a stated size. What
    is broadcast is a row for each vector length.
    """

    def __init__(self, vectors: DataFrame) -> None:
        self.vectors, self.means = vectors, centres(vectors)
        self.codes = stage(coded(vectors, self.means), "codes")

    def scan(self, queries: DataFrame, work, columns: str) -> DataFrame:
        """``work(search, bound, codes, length, scalar)`` for every block and run: query and code places, and more columns."""
        cores, means = self.vectors.sparkSession.sparkContext.defaultParallelism, self.means
        sizes = self.codes.groupBy("dim").agg(F.count("*").alias("n"))
        asked = queries.groupBy("dim").agg(F.count("*").alias("asked"))
        runs = F.greatest(F.ceil(F.col("n") / RUN_ROWS), F.least(F.lit(2 * cores), F.ceil(F.col("n") / TILE_QUERIES)))
        blocks = F.ceil(F.col("asked") * F.col("dim") / QUERY_NUMBERS)
        cuts = F.broadcast(sizes.join(asked, "dim").select("dim", runs.cast("int").alias("runs"), blocks.cast("int").alias("blocks")))

        def dealt(key: str, parts: str) -> Column:
            return F.pmod(F.xxhash64(key), F.col(parts)).cast("int")

        keys = ["dim", "block", "run"]
        codes = self.codes.join(cuts, "dim").withColumn("run", dealt("row", "runs"))
        codes = codes.withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        codes = codes.select(*keys, "row", "code", "length", "scalar")
        blocked = queries.join(cuts, "dim").withColumn("block", dealt("query", "blocks"))
        blocked = blocked.withColumn("run", F.explode(F.sequence(F.lit(0), F.col("runs") - 1))).select(*keys, "query", "vector", "bound")
        blocked = blocked.toDF(*blocked.columns)  # columns of its own, as both sides come from one table
        names = [name for name, _ in (c.split() for c in columns.split(", "))]

        def meet(key: tuple, asking: pa.Table, run: pa.Table) -> pa.Table:
            own, rows = asking.column("query").to_numpy(), run.column("row").to_numpy()
            if not len(own) or not len(rows):
                return pa.table({name: pa.array([], pa.int64() if kind == "long" else pa.float64()) for name, kind in (c.split() for c in columns.split(", "))})
            dim = key[0].as_py()
            search = Search(matrix(asking.column("vector").combine_chunks(), dim), means.get(dim, np.zeros(dim)))
            packed = np.frombuffer(b"".join(run.column("code").to_pylist()), np.uint8).reshape(len(rows), -1)
            i, j, *more = work(search, asking.column("bound").to_numpy(), packed, run.column("length").to_numpy(), run.column("scalar").to_numpy())
            return pa.table(dict(zip(names, (own[i], rows[j], *more), strict=True)))

        return blocked.groupBy(*keys).cogroup(codes.groupBy(*keys)).applyInArrow(meet, columns)

    def apart(self, pairs: DataFrame, queries: DataFrame) -> DataFrame:
        """``pairs (query, row)`` with their true distance as ``score``."""
        asked = queries.select("query", F.col("vector").alias("asked"))
        met = pairs.join(self.vectors.select("row", "vector"), "row").join(asked.toDF(*asked.columns), "query")
        return met.select("query", "row", distance(F.col("vector"), F.col("asked")).alias("score"))

    def nearest(self, queries: DataFrame, k: int) -> DataFrame:
        """``query, row, score`` of all rows that may be among the k nearest of ``queries (dim, query, vector)``."""
        free = queries.withColumn("bound", F.lit(None).cast("double"))
        first = self.scan(free, lambda search, bound, *codes: search.best(*codes, FIRST * k), "query long, row long, estimate double")
        at = F.row_number().over(Window.partitionBy("query").orderBy("estimate", "row"))
        few = first.withColumn("at", at).filter(F.col("at") <= FIRST * k).select("query", "row")
        kth = F.try_element_at(F.sort_array(F.collect_list("score")), F.lit(k)).alias("reach")
        reach = self.apart(few, queries).groupBy("query").agg(kth)
        square = F.coalesce(F.col("reach") * F.col("reach") * (1 + 1e-9), F.lit(float("inf")))
        bounded = stage(queries.join(reach, "query", "left").select("dim", "query", "vector", square.alias("bound")), "bounds")
        found = self.scan(bounded, lambda search, bound, *codes: search.within(*codes, bound), "query long, row long")
        return self.apart(found, bounded)


def nearest(embeddings: DataFrame, every: int, k: int = K) -> DataFrame:
    """``query_id, rank, vec_id, score``: the k nearest of each row whose id ``every`` divides.

    Every row but the query's own is a candidate, also one with the same id; nearest
    first, ties to the smaller id, then to the earlier row. Vectors that are null, zero
    or hold null or non-finite components take no part; a row without an id is only a
    candidate. A repeated query row has its own ranks. Other columns are not read; an
    empty table gives no rows.
    """
    vector = F.col("embedding").cast("array<double>")
    rows = embeddings.select(F.col("vec_id").cast("long").alias("vec_id"), vector.alias("vector")).filter(usable(F.col("vector")))
    rows = rows.withColumns({"dim": F.size("vector"), "row": F.monotonically_increasing_id(), "key": F.xxhash64("vector")})
    vectors = stage(rows, "vectors")

    copies = Window.partitionBy("key", "vector").orderBy("vec_id", "row")
    searched = vectors.withColumn("copy", F.row_number().over(copies)).filter(F.col("copy") <= k + 1)
    searched = stage(searched.select("dim", "row", "vec_id", "vector"), "searched")
    asking = vectors.filter(F.col("vec_id") % every == 0)
    asked = stage(asking.groupBy("key", "vector").agg(F.min("row").alias("query"), F.first("dim").alias("dim")), "queries")

    scored = Index(searched).nearest(asked.select("dim", "query", "vector"), k + 1)
    scored = scored.join(searched.select("row", "vec_id"), "row")
    nearer = ("score", "vec_id", "row")
    at = F.row_number().over(Window.partitionBy("query").orderBy(*nearer))
    best = scored.withColumn("at", at).filter(F.col("at") <= k + 1).drop("at")

    each = asking.select("key", "vector", F.col("vec_id").alias("query_id"), F.col("row").alias("itself"))
    each = each.join(asked.select("key", "vector", "query"), ["key", "vector"]).select("query_id", "itself", "query")
    own = Window.partitionBy("itself").orderBy(*nearer)
    ranked = each.join(best, "query").filter("row <> itself").withColumn("rank", F.row_number().over(own)).filter(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")
