"""Old and new order of one fixed pool of candidates, side by side, for reviewers.

The pool is a bounded queue with positions. Only ids, kinds, codes and counts
reach the packet; texts never do.
"""

from __future__ import annotations

import hashlib
import json
from collections import Counter

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.operators import freshness, relations
from quillon.plans.staging import stage

# The version of the policy and the targets that a review is held to.
POLICY_VERSION = 2
RUBRIC = {
    "top_10": {
        "actionable_precision_target": 0.70,
        "useful_precision_target": 0.90,
        "category_accuracy_target": 0.90,
        "relationship_explained_false_concern_limit": 0,
    },
    "top_20": {
        "actionable_precision_target": 0.60,
        "useful_precision_target": 0.80,
        "category_accuracy_target": 0.80,
        "relationship_explained_false_concern_limit": 2,
    },
    "reviewer_minutes_limit": 25,
    "queue_ratings": {
        "action": ["actionable", "likely_action_correct", "known_positive_retained"],
        "informational": ["useful", "relationship_explained_false_concern"],
    },
    "ratings": ["actionable", "useful", "likely_action_correct", "relationship_explained_false_concern", "reviewer_minutes"],
}


def fingerprint(value: dict) -> str:
    """SHA-256 of the value as JSON with sorted keys and no blanks."""
    return hashlib.sha256(json.dumps(value, ensure_ascii=False, separators=(",", ":"), sort_keys=True).encode()).hexdigest()


def check_pool(pool: DataFrame, records: DataFrame) -> None:
    """Fails where a record id repeats or is empty, a candidate repeats, or an end is unknown."""
    wrong = records.groupBy("id").count().filter("count > 1 OR id IS NULL OR id = ''")
    if not wrong.isEmpty():
        raise ValueError("record ids must be unique and not empty")
    same = F.coalesce(F.col("issue_id") == F.col("related_issue_id"), F.lit(True))
    if not pool.filter(same | (F.col("issue_id") == "") | (F.col("related_issue_id") == "")).isEmpty():
        raise ValueError("a candidate needs two different records")
    if not pool.groupBy("kind", "issue_id", "related_issue_id").count().filter("count > 1").isEmpty():
        raise ValueError("a candidate is in the pool twice")
    ends = pool.select(F.explode(F.array("issue_id", "related_issue_id")).alias("id"))
    if not ends.join(records, "id", "left_anti").isEmpty():
        raise ValueError("a candidate's record is not in the snapshot")


def context_receipts(neighbours: DataFrame, ids: DataFrame) -> list[dict]:
    """For each id its first edges both ways and how many were left out; empty without any."""
    rows = ids.select("id").distinct().join(neighbours, "id", "left").orderBy("id", "direction", "place").collect()
    out: dict[str, dict] = {}
    for r in rows:
        own = out.setdefault(r.id, {"issue_id": r.id, "incoming": [], "outgoing": [], "omitted_incoming_count": 0, "omitted_outgoing_count": 0})
        if r.direction is not None:
            source, target = (r.id, r.other) if r.direction == "outgoing" else (r.other, r.id)
            own[r.direction].append({"source_id": source, "target_id": target, "type": r.relationship_type})
            own[f"omitted_{r.direction}_count"] = r.omitted
    return list(out.values())


def queue_receipt(ids: list[str], budget: int) -> dict:
    """What a queue of a budget shows, and why it stops."""
    shown = ids[:budget]
    return {
        "budget": budget, "available_count": len(ids), "emitted_count": len(shown), "omitted_count": len(ids) - len(shown),
        "stopping_reason": "source-exhausted" if len(shown) == len(ids) else "budget-reached", "candidate_ids": shown,
    }


def shadow_packet(
    pool: DataFrame,
    records: DataFrame,
    edges: DataFrame,
    active: DataFrame,
    scope_complete: bool = True,
    degraded: bool = False,
    context_limit: int = 4,
    action_budget: int = 20,
    informational_budget: int = 20,
) -> dict:
    """The packet of a pool of candidates with their old ``position``, with its fingerprint."""
    if context_limit < 1:
        raise ValueError("context_limit must be positive")
    if min(action_budget, informational_budget) < 0:
        raise ValueError("budgets must not be negative")
    check_pool(pool, records)
    ranked = stage(freshness.queue(freshness.classify(pool, records, edges, active, scope_complete, degraded)), "shadow-pool")
    around = relations.bounded_neighbours(relations.context_edges(edges, records), records, context_limit, pool)
    receipts = context_receipts(around, ranked.select(F.explode(F.array("issue_id", "related_issue_id")).alias("id")))
    rows = [
        {
            "candidate_id": f"{r.kind}|{r.issue_id}|{r.related_issue_id}", "issue_id": r.issue_id, "related_issue_id": r.related_issue_id,
            "legacy_position": r.position, "likely_action": r.likely_action, "review_tier": r.review_tier,
            "evidence_codes": list(r.evidence_codes), "freshness_position": r.freshness_position,
        }
        for r in ranked.orderBy("freshness_position").collect()
    ]
    names = [r["candidate_id"] for r in rows]
    of = lambda tier: [r["candidate_id"] for r in rows if r["review_tier"] == tier]
    count = lambda key: dict(sorted(Counter(r[key] for r in rows).items()))
    stable = {
        "shadow_policy_version": POLICY_VERSION, "analysis_status": "degraded" if degraded else "complete",
        "relationship_scope_complete": scope_complete, "context_limit": context_limit, "source_candidate_count": len(rows),
        "ranked_candidates": rows, "relationship_contexts": receipts,
        "prefixes": {"top_10": names[:10], "top_20": names[:20], "top_10_is_strict_prefix_of_top_20": len(names) > 10},
        "review_queues": {"action": queue_receipt(of("action"), action_budget), "informational": queue_receipt(of("informational"), informational_budget)},
        "summary": {
            "by_likely_action": count("likely_action"), "by_review_tier": count("review_tier"), "reviewed_endpoint_count": len(receipts),
            "omitted_relationship_context": sum(c["omitted_incoming_count"] + c["omitted_outgoing_count"] for c in receipts),
        },
        "evaluation_rubric": RUBRIC,
    }
    return {**stable, "shadow_fingerprint": fingerprint(stable)}
