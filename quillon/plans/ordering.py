"""Places in an order, without sorting a table in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillon.plans.staging import stage


def numbered(rows: DataFrame, order: list[Column], name: str = "position") -> DataFrame:
    """``rows`` with their place from 1 in ``order``.

    Rows are dealt to ranges of the order, sorted and counted there; the sizes of the
    ranges before it give each row its place. What is broadcast is a number for each
    range. Rows that ``order`` holds equal stand together and are numbered as they come.
    """
    at = F.monotonically_increasing_id()
    dealt = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    placed = stage(dealt.withColumns({"_part": F.shiftright(at, 33), "_at": at.bitwiseAND((1 << 33) - 1)}), "ordered")
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    sizes = placed.groupBy("_part").agg(F.count("*").alias("_rows")).withColumn("_base", F.coalesce(F.sum("_rows").over(before), F.lit(0)))
    joined = placed.join(F.broadcast(sizes.drop("_rows")), "_part")
    return joined.withColumn(name, F.col("_base") + F.col("_at") + 1).drop("_part", "_at", "_base")
