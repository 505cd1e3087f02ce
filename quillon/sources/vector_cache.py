"""Vectors by the content of their texts, kept from run to run.

A cache is a folder of batches, one for each run that had misses, partitioned by
the first two digits of the key. A batch counts once its ``_SUCCESS`` file is
there, which Spark writes after the last task of the job: of attempts at a task
one is kept, and a run that dies leaves a batch that nobody reads. Two runs at
once may both add a key; the reader takes one of its rows.

A row is used only if model, revision and dimension are those asked for, all
numbers are finite, not all are zero and the checksum holds. Any other row, and
any file that cannot be read, is a miss and is encoded anew.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillon.operators.incremental import content_key
from quillon.plans.staging import stage

SHELF_DIGITS = 2  # so 256 shelves at most
ROW = T.StructType(
    [T.StructField("key", T.StringType()), T.StructField("model_id", T.StringType()), T.StructField("revision", T.StringType()), T.StructField("v", T.ArrayType(T.DoubleType())),
     T.StructField("checksum", T.LongType()), T.StructField("shelf", T.StringType())]
)


@dataclass(frozen=True)
class Model:
    """What made the vectors: its name, its revision and how many numbers they have."""

    model_id: str
    revision: str
    dimension: int


def _checksum() -> Column:
    return F.xxhash64("key", "model_id", "revision", "v")


def _batches(spark: SparkSession, root: str) -> list[str]:
    """The batches that were written to their end; as many as there were runs with misses."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{root}/batch=*/_SUCCESS")
    found = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(path) or []
    return sorted(str(f.getPath().getParent()) for f in found)


def read(spark: SparkSession, root: str, model: Model, shelves: list[str] | None = None) -> DataFrame:
    """``key, shelf, v``: one sound row for each key; only the named shelves are opened."""
    batches = _batches(spark, root)
    if not batches:
        return spark.createDataFrame([], ROW).select("key", "shelf", "v")
    rows = spark.read.schema(ROW).option("basePath", root).option("ignoreCorruptFiles", True).parquet(*batches)
    if shelves is not None:
        rows = rows.filter(F.col("shelf").isin(shelves))
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    sound = (F.col("model_id") == model.model_id) & (F.col("revision") == model.revision) & (F.size("v") == model.dimension)
    sound = sound & finite & F.exists("v", lambda x: x != 0) & (F.col("checksum") == _checksum()) & F.col("key").rlike("^[0-9a-f]{64}$")
    return rows.filter(F.coalesce(sound, F.lit(False))).groupBy("key", "shelf").agg(F.min("v").alias("v"))


def append(vectors: DataFrame, root: str, model: Model) -> None:
    """Add ``vectors (key, v)`` as a batch of its own."""
    named = vectors.select("key", F.lit(model.model_id).alias("model_id"), F.lit(model.revision).alias("revision"), F.col("v").cast("array<double>").alias("v"))
    rows = named.withColumns({"checksum": _checksum(), "shelf": F.substring("key", 1, SHELF_DIGITS)})
    rows.repartition("shelf").write.partitionBy("shelf").parquet(f"{root}/batch={uuid.uuid4().hex}")


@dataclass(frozen=True)
class Cached:
    """Vectors of all texts, and how many distinct texts were found and were encoded."""

    vectors: DataFrame
    hits: int
    encoded: int


def cached_vectors(texts: DataFrame, encode: Callable[[DataFrame], DataFrame], model: Model, root: str) -> Cached:
    """``id, v`` of ``texts (id, text)``, a text being encoded once, in whichever run it is first met.

    ``encode`` gets ``id, text`` with keys as ids and returns ``id, v``. It must
    return a sound vector for each; else nothing is added. Equal texts share a
    key; a null text counts as an empty one.
    """
    spark = texts.sparkSession
    root = root.rstrip("/")
    text = F.coalesce("text", F.lit(""))
    keyed = stage(texts.select("id", content_key(model.model_id, model.revision, text).alias("key"), text.alias("text")), "keyed-texts")
    wanted = keyed.groupBy("key").agg(F.min("text").alias("text")).withColumn("shelf", F.substring("key", 1, SHELF_DIGITS))
    shelves = [r.shelf for r in keyed.select(F.substring("key", 1, SHELF_DIGITS).alias("shelf")).distinct().collect()]  # 256 at most
    known = read(spark, root, model, shelves)
    found = stage(wanted.join(known, ["shelf", "key"], "left").select("key", F.when(F.col("v").isNull(), F.col("text")).alias("text"), "v"), "cache-reads")
    missing = found.filter("v IS NULL").select(F.col("key").alias("id"), "text")
    asked, hits = found.agg(F.count_if(F.col("v").isNull()), F.count("v")).first()
    vectors = found.filter("v IS NOT NULL").select("key", "v")
    if asked:
        made = stage(encode(missing).select(F.col("id").alias("key"), "v"), "encoded")
        good = F.count_if((F.size("v") == model.dimension) & F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))))
        rows, keys, sound = made.agg(F.count("*"), F.countDistinct("key"), good).first()
        if not rows == keys == sound == asked:
            raise ValueError("the encoder did not return one sound vector for each text")
        append(made, root, model)
        vectors = vectors.unionByName(made)
    return Cached(keyed.select("id", "key").join(vectors, "key").select("id", "v"), hits, asked)
