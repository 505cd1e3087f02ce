"""Work records and typed edges as the driver's tables stand in for them.

``documents`` become records by arithmetic on ``doc_id``; see the README.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.model import ACTIVE_STATUSES, CLOSED_STATUSES
from quillon.operators.vectors import unit_vectors
from quillon.plans.staging import spread


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def record_id(n: Column) -> Column:
    return F.format_string("doc-%06d", n)


def records(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, n = spread(table(spark, sf_dir, "documents")), F.col("doc_id")
    parents = table(spark, sf_dir, "documents").groupBy("source").agg(F.min("doc_id").alias("first_id"))
    lines = F.split("text", "\n")
    status = F.element_at(F.array(*map(F.lit, ("closed", "open", "in_progress", "blocked"))), (n % 4 + 1).cast("int"))
    moment = F.timestamp_seconds(F.lit(1704067200) + n * 60)
    return docs.join(parents, "source", "left").select(
        n.alias("n"),
        record_id(n).alias("id"),
        F.element_at(lines, 1).alias("title"),
        F.array_join(F.slice(lines, 2, 1 << 30), "\n").alias("description"),
        status.alias("status"),
        F.when(n % 31 == 0, "epic").otherwise("task").alias("issue_type"),
        (n % 5).cast("int").alias("priority"),
        F.array("lang", "source").alias("labels"),
        F.when(F.col("first_id") != n, record_id(F.col("first_id"))).alias("parent_id"),
        F.coalesce(F.try_element_at(lines, F.lit(2)), F.lit("")).alias("acceptance_criteria"),
        F.lit("").alias("design"),
        F.lit("").alias("notes"),
        F.date_format(moment, "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("updated_at"),
        (n % 29 == 0).alias("ephemeral"),
    )


def typed_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Typed edges between neighbouring ids, some of them both ways, some repeated."""
    docs = table(spark, sf_dir, "documents").select("doc_id")
    rules = [(5, 1, "blocks", False), (11, 2, "discovered-from", False), (13, 3, "parent-child", False), (7, 1, "blocks", True), (35, 1, "related", False), (17, 4, "relates-to", True)]
    made = F.array(
        *[
            F.when(
                (F.col("doc_id") % every == 0) & (F.col("doc_id") >= back),
                F.struct(
                    (F.col("doc_id") - (back if turned else 0)).alias("s"), (F.col("doc_id") - (0 if turned else back)).alias("t"), F.lit(kind).alias("kind")
                ),
            )
            for every, back, kind, turned in rules
        ]
    )
    rows = docs.select(F.explode(F.filter(made, lambda e: e.isNotNull())).alias("e"))
    return rows.select(record_id(F.col("e.s")).alias("source_id"), record_id(F.col("e.t")).alias("target_id"), F.col("e.kind").alias("relationship_type"))


def legacy_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Untyped dependencies: those of some typed edges, and some with no type."""
    docs = table(spark, sf_dir, "documents").select("doc_id").filter("doc_id >= 4")
    back = F.when(F.col("doc_id") % 19 == 0, F.lit(4)).when(F.col("doc_id") % 5 == 0, F.lit(1))
    rows = docs.withColumn("back", back).filter("back IS NOT NULL")
    return rows.select(record_id(F.col("doc_id")).alias("source_id"), record_id(F.col("doc_id") - F.col("back")).alias("target_id"))


def is_closed(status: Column) -> Column:
    return F.coalesce(F.lower(status).isin(*CLOSED_STATUSES), F.lit(False))


def excluded_reason(statuses: tuple[str, ...] = ACTIVE_STATUSES) -> Column:
    """Why a record is outside the population, in the order of the tests; null if inside."""
    wanted = F.coalesce(F.lower("status").isin(*statuses), F.lit(False))
    return F.when(~wanted, "status").when(F.lower("issue_type") == "epic", "epic").when(F.col("ephemeral"), "ephemeral")


def population(rows: DataFrame, statuses: tuple[str, ...] = ACTIVE_STATUSES) -> DataFrame:
    return rows.filter(excluded_reason(statuses).isNull())


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings").select(record_id(F.col("vec_id")).alias("id"), "embedding")
    known = table(spark, sf_dir, "documents").select(record_id(F.col("doc_id")).alias("id"))
    return unit_vectors(rows.join(known, "id", "left_semi"), "id", "embedding")
