"""A JSON array of objects read by many tasks, however long its one document is.

The text source cuts the document at every ``}``, which lets Spark split the file
anywhere. What a piece does to the document's state is known but for one bit,
whether it starts inside a string, so each split sums up both cases, a prefix over
the splits (a row each) settles them, and windows within a split give every
piece its depth. A record ends at the ``}`` that returns to the array's depth.

Lists of another layout (an envelope whose records do not come first, objects
after the records, elements that are no objects, an empty list, several files) are
left to the caller's whole-document reader, as ``None`` says.
"""

from __future__ import annotations

import json
import re

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillon.plans.staging import stage

ARRAY_HEAD = r"^\s*\[\s*(?=\{)"
STRING = r'"[^"]*("|\z)'  # escapes are taken out before


def pieces(spark: SparkSession, path: str) -> DataFrame:
    """``split, at, value``: the text between two ``}``; ``at`` orders a split's pieces."""
    text = spark.read.option("lineSep", "}").text(path)
    return text.select(F.col("_metadata.file_block_start").alias("split"), F.monotonically_increasing_id().alias("at"), "value")


def _turned(value: Column) -> list[Column]:
    """How a piece and the ``}`` after it change the state: quotes, the change of depth
    if it starts outside and if it starts inside a string, and whether a single
    quote stands outside of strings, for either case."""
    plain = F.regexp_replace(value, r"(?s)\\.", "")
    odd = F.regexp_count(plain, F.lit('"')) % 2
    out = []
    for k, started in enumerate((plain, F.concat(F.lit('"'), plain))):
        bare = F.regexp_replace(started, STRING, "")
        depth = F.regexp_count(bare, F.lit(r"[\[{]")) - F.regexp_count(bare, F.lit(r"[\]}]")) - F.when(odd == k, 1).otherwise(0)
        out += [depth.alias(f"depth{k}"), F.contains(bare, F.lit("'")).alias(f"odd{k}")]
    return [odd.alias("quotes"), *out]


def _before(column: str | Column, window) -> Column:
    """The sum of a column over the rows before this one."""
    return F.coalesce(F.sum(column).over(window.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))


def _with_states(parts: DataFrame, within) -> DataFrame:
    """``parts`` with ``inside`` (starts in a string) and ``depth`` after the piece.

    What goes over all splits in one window is a row for each split.
    """
    seen = parts.withColumn("parity", _before("quotes", within) % 2)
    both = [F.sum(F.when(F.col("parity") == s, F.col("depth0")).otherwise(F.col("depth1"))).alias(f"sum{s}") for s in (0, 1)]
    splits = seen.groupBy("split").agg(F.sum("quotes").alias("quotes"), *both)
    order = Window.orderBy("split")
    splits = splits.withColumn("start", _before("quotes", order) % 2)
    change = F.when(F.col("start") == 0, F.col("sum0")).otherwise(F.col("sum1"))
    splits = stage(splits.select("split", "start", _before(change, order).alias("above")), "json-splits")
    inside = (F.col("parity") + F.col("start")) % 2 == 1
    states = seen.join(F.broadcast(splits), "split").withColumn("inside", inside)
    own = F.when(F.col("inside"), F.col("depth1")).otherwise(F.col("depth0"))
    depth = F.col("above") + F.sum(own).over(within.rowsBetween(Window.unboundedPreceding, 0))
    return states.select("split", "at", "value", "inside", depth.alias("depth"), F.when(F.col("inside"), F.col("odd1")).otherwise(F.col("odd0")).alias("odd"), "quotes")


def _head(spark: SparkSession, path: str, names: tuple[str, ...]) -> tuple[str, int] | None:
    """The pattern of what stands before the first record and the depth of the array."""
    first = pieces(spark, path).filter("split = 0").orderBy("at").select("value").first()
    envelope = r'^\s*\{\s*"(%s)"\s*:\s*\[\s*(?=\{)' % "|".join(map(re.escape, names))
    for depth, pattern in ((1, ARRAY_HEAD), (2, envelope)):
        if first is not None and re.match(pattern, first.value, re.ASCII):
            return pattern, depth
    return None


def _closed(tail: list[str], depth: int, names: tuple[str, ...]) -> bool:
    """Whether the pieces after the last record close the list and hold no other one."""
    if depth == 1:
        return len(tail) == 1 and tail[0].strip() == "]"
    if not tail or len(tail) > 2 or (len(tail) == 2 and tail[1].strip()):
        return False
    try:
        rest = json.loads('{"":[' + tail[0] + "}")
    except ValueError:
        return False
    return not set(rest) & set(names)


def split_objects(spark: SparkSession, path: str, names: tuple[str, ...] = ()) -> DataFrame | None:
    """``raw``: the objects of the array in the file, one a row, or None for another layout.

    The array is the document or, in an object, the value of the first key, one
    of ``names``. A record that is no sound JSON object fails when it is read.
    """
    found = _head(spark, path, names)
    if found is None or len(spark.read.text(path).inputFiles()) != 1:
        return None
    head, depth = found
    within = Window.partitionBy("split").orderBy("at")
    parts = pieces(spark, path).select("split", "at", "value", *_turned(F.col("value")))
    outside = (F.col("inside").cast("int") + F.col("quotes")) % 2 == 0
    ends = (outside & (F.col("depth") == depth)).cast("int")
    numbered = _with_states(parts, within).withColumn("ends", ends).withColumn("n", _before("ends", within))
    numbered = stage(numbered.select("split", "at", "value", "odd", "ends", "n"), "json-pieces")
    counts = numbered.groupBy("split").agg(F.sum("ends").alias("records"))
    counts = stage(counts.select("split", _before("records", Window.orderBy("split")).alias("above"), "records"), "json-counts")
    records = counts.agg(F.sum("records")).first()[0]
    placed = numbered.join(F.broadcast(counts.select("split", "above")), "split").withColumn("n", F.col("n") + F.col("above"))
    tail = placed.filter(F.col("n") == records).orderBy("split", "at").limit(3).collect()
    if not records or not _closed([r.value for r in tail], depth, names):
        return None
    own = F.array_sort(F.collect_list(F.struct("split", "at", "value")))
    text = F.concat(F.array_join(F.transform(own, lambda p: p["value"]), "}"), F.lit("}"))
    whole = placed.filter(F.col("n") < records).groupBy("n").agg(text.alias("text"), F.max("odd").alias("odd"))
    lead = F.when(F.col("n") == 0, F.lit(head)).otherwise(F.lit(r"^\s*,\s*(?=\{)"))
    whole = stage(whole.select((F.col("odd") | ~F.regexp(F.col("text"), lead)).alias("odd"), F.regexp_replace("text", lead, F.lit("")).alias("raw")), "json-records")
    if not whole.filter("odd").isEmpty():
        return None
    sound = F.from_json("raw", "map<string,string>").isNotNull()
    return whole.select(F.when(sound, F.col("raw")).otherwise(F.raise_error(F.lit("a record is no JSON object"))).alias("raw"))
