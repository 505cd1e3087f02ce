"""Joins with the typed relationship graph, and its accounting."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillon.model import CONTEXT_CLOSED_STATUSES, NO_LINK
from quillon.sources.records import is_closed

# Kinds that count the same in both directions, and the order in
# which one relation of a pair is kept.
SYMMETRIC_TYPES = ("duplicate", "related", "similar")
RELATION_PRIORITY = ("blocks", "duplicate", "related", "similar")
CONTEXT_PRIORITY = ("blocks", "depends-on", "duplicate-of", "parent-child", "discovered-from", "relates-to", "similar-to")


def normalized_edges(typed: DataFrame, legacy: DataFrame) -> DataFrame:
    """Distinct typed edges; a legacy dependency counts only where its pair has no typed one."""
    clean = typed.select("source_id", "target_id", "relationship_type").distinct()
    bare = legacy.select("source_id", "target_id").distinct().join(clean, ["source_id", "target_id"], "left_anti")
    return clean.unionByName(bare.withColumn("relationship_type", F.lit("depends-on")))


def direct_relations(edges: DataFrame) -> DataFrame:
    """One row for each directed pair: whether a parent-child edge, and the smallest other type."""
    return edges.groupBy("source_id", "target_id").agg(
        F.bool_or(F.col("relationship_type") == "parent-child").alias("parent_child"),
        F.min(F.when(F.col("relationship_type") != "parent-child", F.col("relationship_type"))).alias("other"),
    )


def with_structure(pairs: DataFrame, records: DataFrame, edges: DataFrame) -> DataFrame:
    """Pairs (left_id, right_id) with ``structural_context`` and dependency evidence.

    Relations and parents of each other meet the pairs as pairs, in one shuffle. The names
    of parents are looked up at both ends only of pairs that can have one in common: where
    there is a column ``alike``, which is dropped, of those that it does not rule out.
    """
    direct = direct_relations(edges)
    fwd = direct.select(F.col("source_id").alias("left_id"), F.col("target_id").alias("right_id"), F.col("parent_child").alias("f_pc"), F.col("other").alias("f_t"))
    rev = direct.select(F.col("target_id").alias("left_id"), F.col("source_id").alias("right_id"), F.col("parent_child").alias("r_pc"), F.col("other").alias("r_t"))
    parents = records.filter("parent_id IS NOT NULL").select("id", "parent_id")
    family = parents.select(F.col("id").alias("left_id"), F.col("parent_id").alias("right_id"))
    family = family.unionByName(family.select(F.col("right_id").alias("left_id"), F.col("left_id").alias("right_id"))).distinct().withColumn("family", F.lit(True))
    some, none = pairs, None
    if "alike" in pairs.columns:
        some = pairs.filter("alike IS NULL OR alike").drop("alike")
        none = pairs.filter("NOT alike").drop("alike").withColumns({c: F.lit(None).cast("string") for c in ("left_parent", "right_parent")})
    rows = some.join(parents.select(F.col("id").alias("left_id"), F.col("parent_id").alias("left_parent")), "left_id", "left")
    rows = rows.join(parents.select(F.col("id").alias("right_id"), F.col("parent_id").alias("right_parent")), "right_id", "left")
    rows = rows if none is None else rows.unionByName(none)
    known = fwd.join(rev, ["left_id", "right_id"], "full").join(family, ["left_id", "right_id"], "full")
    rows = rows.join(known, ["left_id", "right_id"], "left")
    says = lambda a, b, t: F.concat(F.col(a), F.lit(" depends on "), F.col(b), F.lit(" ("), F.col(t), F.lit(")"))
    context = (
        F.when(F.col("family"), "parent/child")
        .when(F.col("f_pc"), "parent/child")
        .when(F.col("f_t").isNotNull(), says("left_id", "right_id", "f_t"))
        .when(F.col("r_pc"), "parent/child")
        .when(F.col("r_t").isNotNull(), says("right_id", "left_id", "r_t"))
        .when((F.col("left_parent") != "") & (F.col("left_parent") == F.col("right_parent")), F.concat(F.lit("same parent "), F.col("left_parent")))
        .otherwise(NO_LINK)
    )
    rows = rows.withColumns({
        "structural_context": context,
        "evidence_type": F.coalesce("f_t", "r_t"),
        "evidence_source": F.when(F.col("f_t").isNotNull(), F.col("left_id")).when(F.col("r_t").isNotNull(), F.col("right_id")),
        "evidence_target": F.when(F.col("f_t").isNotNull(), F.col("right_id")).when(F.col("r_t").isNotNull(), F.col("left_id")),
    })
    return rows.drop("f_pc", "f_t", "r_pc", "r_t", "left_parent", "right_parent", "family")


def edges_with_endpoints(edges: DataFrame, records: DataFrame) -> DataFrame:
    """Edges with both endpoint states; a missing endpoint has a null status."""
    state = records.select("id", "status")
    rows = edges.join(state.select(F.col("id").alias("source_id"), F.col("status").alias("source_status")), "source_id", "left")
    return rows.join(state.select(F.col("id").alias("target_id"), F.col("status").alias("target_status")), "target_id", "left")


def funnel_classes(edges: DataFrame, records: DataFrame, active: DataFrame, vectors: DataFrame, echo: float, overlap: float, margin: float) -> DataFrame:
    """Each non-parent edge with its class: inactive, below or eligible."""
    rows = edges_with_endpoints(edges.filter("relationship_type <> 'parent-child'").distinct(), records)
    live = active.select("id")
    rows = rows.join(live.select(F.col("id").alias("source_id"), F.lit(1).alias("sa")), "source_id", "left")
    rows = rows.join(live.select(F.col("id").alias("target_id"), F.lit(1).alias("ta")), "target_id", "left")
    ends = F.coalesce("sa", F.lit(0)) + F.coalesce("ta", F.lit(0))
    comparable = F.col("target_status").isNotNull() & ((ends == 2) | ((ends == 1) & (is_closed(F.col("source_status")) | is_closed(F.col("target_status")))))
    from quillon.operators.vectors import cosine

    a, b = (vectors.select(F.col("id").alias(k), F.col("v").alias(v)) for k, v in (("source_id", "sv"), ("target_id", "tv")))
    rows = rows.withColumn("comparable", comparable).withColumn("ends", ends).join(a, "source_id", "left").join(b, "target_id", "left")
    floor = F.greatest(F.lit(-1.0), F.when(F.col("ends") == 2, F.lit(overlap)).otherwise(F.lit(echo)) - margin)
    score = cosine(F.col("sv"), F.col("tv"))
    kind = F.when(~F.col("comparable") | score.isNull(), "inactive").when(score < floor, "below").otherwise("eligible")
    return rows.select("source_id", "target_id", "relationship_type", kind.alias("class"))


def dependency_funnel(classes: DataFrame) -> DataFrame:
    """Counts by class and of distinct eligible pairs, with the conservation checks."""
    pair = F.when(F.col("class") == "eligible", F.concat(F.least("source_id", "target_id"), F.lit("|"), F.greatest("source_id", "target_id")))
    row = classes.agg(
        F.count("*").alias("total_non_parent_typed"),
        F.count_if(F.col("class") == "inactive").alias("inactive_or_closed_only"),
        F.count_if(F.col("class") == "below").alias("below_qualification"),
        F.count_if(F.col("class") == "eligible").alias("eligible"),
        F.countDistinct(pair).alias("eligible_candidates"),
    )
    return row.withColumn("coalesced_eligible_edges", F.col("eligible") - F.col("eligible_candidates")).withColumn(
        "unaccounted", F.col("total_non_parent_typed") - F.col("inactive_or_closed_only") - F.col("below_qualification") - F.col("eligible")
    )


def assert_conserved(funnel: DataFrame) -> DataFrame:
    """The funnel, or an error that names the terms that do not add up."""
    text = F.format_string("dependency funnel does not conserve: total %d, unaccounted %d", "total_non_parent_typed", "unaccounted")
    return funnel.withColumn("unaccounted", F.when(F.col("unaccounted") == 0, F.col("unaccounted")).otherwise(F.raise_error(text).cast("long")))


def relations_between(edges: DataFrame, pairs: DataFrame) -> DataFrame:
    """All edges of the given unordered pairs (left_id, right_id)."""
    lo, hi = F.least("source_id", "target_id"), F.greatest("source_id", "target_id")
    keyed = edges.withColumns({"lo": lo, "hi": hi})
    wanted = pairs.select(F.least("left_id", "right_id").alias("lo"), F.greatest("left_id", "right_id").alias("hi")).distinct()
    return keyed.join(wanted, ["lo", "hi"]).select("lo", "hi", "source_id", "target_id", "relationship_type").distinct()


def boundary(edges: DataFrame, selected: DataFrame) -> DataFrame:
    """Edges with their place against a selection: retained, outbound, inbound or unrelated."""
    s = selected.select(F.col("id").alias("source_id"), F.lit(True).alias("s_in"))
    t = selected.select(F.col("id").alias("target_id"), F.lit(True).alias("t_in"))
    rows = edges.join(s, "source_id", "left").join(t, "target_id", "left")
    place = (
        F.when(F.col("s_in") & F.col("t_in"), "retained").when(F.col("s_in"), "outbound").when(F.col("t_in"), "inbound").otherwise("unrelated")
    )
    return rows.select("source_id", "target_id", "relationship_type", place.alias("boundary"))


def priority(kind: Column, order: tuple[str, ...] = RELATION_PRIORITY) -> Column:
    out = F.lit(len(order))
    for k, name in reversed(list(enumerate(order))):
        out = F.when(kind == name, k).otherwise(out)
    return out


def canonical_relations(edges: DataFrame) -> DataFrame:
    """One relation for each unordered pair: the best type; symmetric ones in id order."""
    turned = F.col("relationship_type").isin(*SYMMETRIC_TYPES) & (F.col("source_id") > F.col("target_id"))
    rows = edges.select(
        F.when(turned, F.col("target_id")).otherwise(F.col("source_id")).alias("source_id"),
        F.when(turned, F.col("source_id")).otherwise(F.col("target_id")).alias("target_id"),
        "relationship_type",
    )
    best = F.min_by(F.struct("source_id", "target_id", "relationship_type"), F.struct(priority(F.col("relationship_type")).alias("p"), "relationship_type", "source_id", "target_id"))
    kept = rows.groupBy(F.least("source_id", "target_id").alias("lo"), F.greatest("source_id", "target_id").alias("hi")).agg(best.alias("e"), F.count("*").alias("relations"))
    return kept.select("lo", "hi", "e.source_id", "e.target_id", "e.relationship_type", (F.col("relations") - 1).alias("collapsed"))


def relation_accounting(edges: DataFrame, selected: DataFrame) -> DataFrame:
    """raw = retained + collapsed + omitted, by place and type sums."""
    places = boundary(edges, selected)
    inside = canonical_relations(places.filter("boundary = 'retained'"))
    counts = inside.agg(F.count("*").alias("retained"), F.coalesce(F.sum("collapsed"), F.lit(0)).alias("collapsed"))
    outside = places.agg(
        F.count("*").alias("raw"), F.count_if(F.col("boundary").isin("outbound", "inbound")).alias("omitted_boundary"), F.count_if(F.col("boundary") == "unrelated").alias("unrelated")
    )
    rows = outside.crossJoin(counts)
    return rows.withColumn("unaccounted", F.col("raw") - F.col("retained") - F.col("collapsed") - F.col("omitted_boundary") - F.col("unrelated"))


def has_reviewable(edges: DataFrame, records: DataFrame, active: DataFrame) -> DataFrame:
    """Whether any non-parent edge touches the active records; stops at the first."""
    live = active.select("id")
    rows = edges.filter("relationship_type <> 'parent-child'")
    hit = rows.join(live, rows["source_id"] == live["id"], "left_semi").limit(1)
    back = rows.join(live, rows["target_id"] == live["id"], "left_semi").limit(1)
    return hit.unionByName(back).agg((F.count("*") > 0).alias("reviewable"))


def context_edges(edges: DataFrame, records: DataFrame) -> DataFrame:
    """Distinct triples of the edges and the parents of records."""
    parents = records.filter("parent_id IS NOT NULL").select(F.col("id").alias("source_id"), F.col("parent_id").alias("target_id"), F.lit("parent-child").alias("relationship_type"))
    return edges.select("source_id", "target_id", "relationship_type").unionByName(parents).distinct()


def bounded_neighbours(edges: DataFrame, records: DataFrame, limit: int = 4, pairs: DataFrame | None = None) -> DataFrame:
    """Each endpoint's first ``limit`` edges by direction: ``id, direction, other, relationship_type, place, omitted``.

    Counterparts in the candidate ``pairs (issue_id, related_issue_id)`` come
    first, then records that are known and not closed, then the kind of relation,
    then ids. Counts and places are made apart, so that of an endpoint with very
    many edges each task sends only its first ones.
    """
    if limit < 1:
        raise ValueError("limit must be positive")
    out = edges.select(F.col("source_id").alias("id"), F.lit("outgoing").alias("direction"), F.col("target_id").alias("other"), "relationship_type")
    into = edges.select(F.col("target_id").alias("id"), F.lit("incoming").alias("direction"), F.col("source_id").alias("other"), "relationship_type")
    both = out.unionByName(into)
    live = ~F.coalesce(F.lower("status").isin(*CONTEXT_CLOSED_STATUSES), F.lit(False))
    rows = both.join(records.filter(live).select(F.col("id").alias("other"), F.lit(0).alias("live")), "other", "left")
    rows = rows.withColumn("near", F.lit(1))
    if pairs is not None:
        one = pairs.select(F.col("issue_id").alias("id"), F.col("related_issue_id").alias("other"))
        ends = one.union(one.select("other", "id")).distinct().withColumn("counterpart", F.lit(0))
        rows = rows.join(ends, ["id", "other"], "left").withColumn("near", F.coalesce("counterpart", F.lit(1)))
    kind = priority(F.lower("relationship_type"), CONTEXT_PRIORITY)
    order = Window.partitionBy("id", "direction").orderBy("near", F.coalesce("live", F.lit(1)), kind, "other", "relationship_type")
    first = rows.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= limit)
    counts = both.groupBy("id", "direction").agg(F.count("*").alias("n"))
    omitted = (F.col("n") - F.least("n", F.lit(limit))).alias("omitted")
    return first.join(counts, ["id", "direction"]).select("id", "direction", "other", "relationship_type", "place", omitted)
