"""A whole review run: from records and vectors to a bounded, explained queue.

Everything up to the queue is a plan over DataFrames. What reaches the driver is
the queue (bounded by the policy's caps), the leads asked for and some counts.
"""

from __future__ import annotations

import hashlib
import json
from dataclasses import asdict, dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillon.functions import text as T
from quillon.model import ACTIVE_STATUSES, CandidatePolicy
from quillon.operators import anchors, explain, freshness, graph, qualify, relations, selection, surfaces
from quillon.operators import vectors as V
from quillon.plans.staging import stage
from quillon.sources.records import is_closed
from quillon.sources.trackers import Snapshot, edges as typed_edges

STOP_WORDS = tuple("about after also been before being between from have into only should that their then this through using when where with".split())
BUCKETS = 256
HUB_LIMIT = 5
TEXTS = ("title", "description", "acceptance_criteria", "design", "notes")


@dataclass(frozen=True)
class Options:
    """What a run is asked for, besides its policy."""

    statuses: tuple[str, ...] = ACTIVE_STATUSES
    include_epics: bool = False
    batch_size: int = 9
    code_surfaces: bool = True
    leads: int = 50
    hub_limit: int = HUB_LIMIT
    include_ephemeral: bool = False
    guarded_pairs: int = 0  # how many of the pairs that the hub guard holds back are told

    def __post_init__(self) -> None:
        if self.guarded_pairs < 0:
            raise ValueError("guarded_pairs must not be negative")
        for name in ("batch_size", "leads", "hub_limit"):
            if getattr(self, name) < 1:
                raise ValueError(f"{name} must be positive")


def texts(records: DataFrame) -> DataFrame:
    """``id, text``: what a record's vector is made of."""
    return records.select("id", T.canonical_text().alias("text"))


def hashing_vectors(records: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """``id, v``: signed hashing vectors of the records' whole texts."""
    return V.hashing_vectors(texts(records), buckets)


@dataclass
class Repository:
    """What is known of the code: files, worktrees and what changed in them, each if handed over.

    ``files (path)``, ``trees (path, head, branch)``, ``changes (worktree, path,
    kind)`` with kinds ``committed``, ``working`` and ``untracked``, ``mappings
    (issue_id, path)``.
    """

    files: DataFrame | None = None
    trees: DataFrame | None = None
    changes: DataFrame | None = None
    mappings: DataFrame | None = None
    revision: str | None = None
    context: str = "unavailable"


@dataclass
class Review:
    """The relations of one run, each built once when it is first asked for."""

    snapshot: Snapshot
    records: DataFrame
    policy: CandidatePolicy = field(default_factory=CandidatePolicy)
    options: Options = field(default_factory=Options)
    vectors: DataFrame | None = None
    repository: Repository = field(default_factory=Repository)
    scope: DataFrame | None = None  # ids that a candidate must touch, in an incremental run

    def __post_init__(self) -> None:
        self.records = stage(self.records.drop("cut"), "records")
        wanted = F.lower("status").isin(*[s.lower() for s in self.options.statuses])
        plain = F.lit(self.options.include_epics) | ~F.coalesce(F.lower("issue_type") == "epic", F.lit(False))
        self.active = self.records.filter(F.coalesce(wanted, F.lit(False)) & plain & (F.lit(self.options.include_ephemeral) | ~F.col("ephemeral")))
        self.edges = typed_edges(self.records)
        self.vectors = stage(hashing_vectors(self.records) if self.vectors is None else self.vectors, "vectors")
        self._made: dict = {}

    def _once(self, name: str, build) -> DataFrame:
        if name not in self._made:
            self._made[name] = stage(build(), name)
        return self._made[name]

    def _qualified(self, policy: CandidatePolicy) -> DataFrame:
        return qualify.qualified(self.records, self.active, self.edges, self.vectors, policy, self.scope)

    def _select(self, policy: CandidatePolicy) -> DataFrame:
        """Decisions under a policy, once the dependency lane's accounts balance.

        Candidates of the baseline's thresholds are protected where a threshold is
        below it.
        """
        rows = stage(self._qualified(policy), "qualified")
        baseline = stage(self._qualified(policy.baseline), "baseline") if policy.looser else None
        made = stage(selection.select_candidates(rows, policy, baseline), "decisions")
        if policy.wants("structure") and self.scope is None and not policy.looser:
            classes = relations.funnel_classes(self.edges, self.records, self.active, self.vectors, policy.echo_threshold, policy.overlap_threshold, policy.exception_margin)
            self._made["accounts"] = selection.check_accounts(selection.dependency_accounts(relations.dependency_funnel(classes), made))
        both = rows if baseline is None else rows.unionByName(baseline.join(rows, ["kind", "issue_id", "related_issue_id"], "left_anti"))
        self._made["qualified"] = both
        return made

    def decisions(self) -> DataFrame:
        if "decisions" not in self._made:
            self._made["decisions"], self._made["degraded"] = selection.with_degradation(self._select, self.policy)
        return self._made["decisions"]

    def qualified(self) -> DataFrame:
        self.decisions()
        return self._made["qualified"]

    def degradation(self) -> dict | None:
        self.decisions()
        return self._made["degraded"]

    def accounts(self) -> dict[str, int] | None:
        """The dependency funnel's counts, of a whole run that was not degraded."""
        self.decisions()
        return self._made.get("accounts") if self._made["degraded"] is None else None

    def replacements(self) -> DataFrame | None:
        """What thresholds above the baseline bring in through caps; None where none is."""
        if not self.policy.stricter:
            return None
        reference = stage(selection.select_candidates(self._qualified(self.policy.baseline), self.policy), "reference")
        return self._once("replacements", lambda: selection.replacements(reference, self.decisions(), self.policy))

    def queue(self) -> DataFrame:
        """Admitted candidates, explained and assessed, with their place."""
        keys = ["kind", "issue_id", "related_issue_id"]

        def build() -> DataFrame:
            kept = self.decisions().filter("decision = 'admitted'").select(*keys, "position")
            rows = stage(self.qualified().join(F.broadcast(kept), keys), "admitted")
            told = explain.explain(rows, self.records, STOP_WORDS)
            seen = freshness.classify(rows, self.records, self.edges, self.active, degraded=self.degradation() is not None)
            return told.join(seen.select(*keys, "likely_action", "review_tier", "evidence_codes"), keys)

        return self._once("queue", build)

    def pointers(self) -> DataFrame:
        """Paths that active records name in their texts, and that their worktrees were seen to change."""
        return self._once("pointers", self._pointers)

    def _pointers(self) -> DataFrame:
        code = self.repository
        texts = self.active.select(F.col("id").alias("issue_id"), F.explode(F.array(*[F.struct(F.lit(c).alias("source_field"), F.col(c).alias("text")) for c in TEXTS])).alias("t"))
        found = surfaces.explicit_pointers(texts.select("issue_id", "t.source_field", "t.text"))
        found = found.withColumns({"source": F.lit(surfaces.EXPLICIT), "revision": F.lit(code.revision).cast("string")})
        found = surfaces.path_presence(found, code.files)
        if code.trees is None or code.changes is None:
            return found
        issues = self.active.select(F.col("id").alias("issue_id"))
        named = issues.limit(0).withColumn("path", F.lit("")) if code.mappings is None else surfaces.check_mappings(code.mappings, issues, code.trees)
        kinds = [code.changes.filter(F.col("kind") == k).select("worktree", "path") for k in ("committed", "working", "untracked")]
        own = surfaces.associate_worktrees(issues, code.trees, named)
        seen = surfaces.observed_pointers(own, code.trees, surfaces.changed_paths(*kinds))
        return found.unionByName(surfaces.path_presence(seen, code.files))

    def guarded_hubs(self, limit: int) -> list[dict]:
        """The first hub surfaces, by kind and number of issues."""
        order = [F.when(F.col("kind") == "path", 0).otherwise(1), F.desc("issue_count"), F.col("surface")]
        hubs = surfaces.hubs(self._surfaces(), self.options.hub_limit)
        return [r.asDict() for r in hubs.orderBy(*order).limit(limit).collect()]

    def _surfaces(self) -> DataFrame:
        return self._once("surfaces", lambda: surfaces.surfaces(self.pointers()))

    def _touched(self) -> DataFrame | None:
        return None if self.scope is None else self.scope.select(F.col("id").alias("issue_id"))

    def shared(self) -> DataFrame:
        """What pairs of active records share, of an incremental run those that touch its scope."""
        return self._once("shared", lambda: surfaces.shared_evidence(self._surfaces(), self.options.hub_limit, scope=self._touched()))

    def collisions(self) -> DataFrame:
        return self._once("collisions", lambda: surfaces.collisions(self.pointers(), self.options.hub_limit, shared=self.shared()))

    def guards(self) -> dict:
        """How many pairs the guards hold back, and the first of the hub guard's, if asked for."""
        counts = surfaces.guard_counts(self._surfaces(), self.shared(), self.options.hub_limit, self._touched())
        if not self.options.guarded_pairs:
            return {**counts, "hub_guard_sample": []}
        sample = surfaces.hub_guard_sample(self._surfaces(), self.shared(), self.options.hub_limit, self.options.guarded_pairs, scope=self._touched())
        return {**counts, "hub_guard_sample": _plain(sample, ["issue_id", "related_issue_id"])}

    def batches(self) -> DataFrame:
        return self._once("batches", lambda: graph.batches(graph.review_units(self.queue(), self.active, self.vectors, self.options.batch_size)))

    def neighbours(self, issue_id: str, limit: int, include_closed: bool = False) -> DataFrame:
        """The nearest records of one: id, rank, score, title and status."""
        if limit < 1:
            raise ValueError("limit must be positive")
        pool = self.active if not include_closed else self.records.filter(is_closed(F.col("status"))).select("id").unionByName(self.active.select("id")).distinct()
        own = self.vectors.filter(F.col("id") == issue_id)
        if not own.limit(1).count():
            raise ValueError("no record of that id has a vector")
        ranks = V.top_ranks(own, self.vectors.join(pool.select("id"), "id", "left_semi"), limit)
        return ranks.join(self.records.select(F.col("id").alias("candidate_id"), "title", "status"), "candidate_id").select("candidate_id", "rank", F.round("score", 6).alias("score"), "title", "status")

    def population(self) -> dict[str, int]:
        """Counts of records, active ones, those without any candidate, and excluded ones."""
        ends = self.qualified().select(F.explode(F.array("issue_id", "related_issue_id")).alias("id")).distinct()
        total, active = self.records.count(), self.active.count()
        return {"records": total, "active": active, "no_signal": self.active.join(ends, "id", "left_anti").count(), "excluded": total - active}


def _plain(rows: DataFrame, order: list[Column | str]) -> list[dict]:
    return [r.asDict(recursive=True) for r in rows.orderBy(*order).collect()]


def _fingerprint(payload: dict) -> str:
    return hashlib.sha256(json.dumps(payload, sort_keys=True, separators=(",", ":"), default=str).encode()).hexdigest()


def _frame(kind: str, review: Review) -> dict:
    return {
        "schema_version": 1, "report_type": kind, "policy": {"read_only": True, "tracker_mutation_allowed": False},
        "snapshot": {**asdict(review.snapshot), "tracker_name": review.snapshot.tracker}, "warnings": list(review.snapshot.warnings),
    }


def _leads(review: Review) -> list[dict]:
    if not review.options.code_surfaces:
        return []
    order = surfaces.collision_order()
    return _plain(review.collisions().withColumn("place", F.row_number().over(Window.orderBy(*order))).filter(F.col("place") <= review.options.leads), ["place"])


def sweep_report(review: Review) -> dict:
    """The queue with lanes, batches and leads; ``analysis_fingerprint`` leaves out where it ran."""
    lanes = {r["lane"]: r for r in _plain(selection.lane_metrics(review.decisions()), ["lane"])}
    for row in lanes.values():
        row["omitted"] = row["qualified"] - row["admitted"]
    body = {
        "population": review.population(), "lane_summary": lanes, "candidates": _plain(review.queue(), ["position"]),
        "batches": _plain(review.batches().filter("kind = 'connected-component'"), ["batch"]), "collisions": _leads(review),
        "dependency_accounts": review.accounts(), "degradation_receipts": [review.degradation()] if review.degradation() else [],
        "cap_replacements": [] if review.replacements() is None else _plain(review.replacements(), ["candidate_id"]),
        "anchor_metrics": _plain(anchors.anchor_metrics(review.queue()), ["total"])[0], "parameters": {**asdict(review.policy), "objectives": sorted(review.policy.objectives or ())},
    }
    stable = {**body, "workspace": review.snapshot.workspace_id}
    return {**_frame("sweep", review), **body, "analysis_fingerprint": _fingerprint(stable), "analysis_status": "degraded" if review.degradation() else "complete"}


def triage_report(sweep: dict) -> dict:
    keep = ("kind", "lane", "issue_id", "related_issue_id", "similarity", "pattern", "likely_action", "review_tier", "what_to_verify")
    short = [{k: c[k] for k in keep} for c in sweep["candidates"]]
    return {**{k: v for k, v in sweep.items() if k not in ("batches", "anchor_metrics", "parameters")}, "report_type": "triage", "candidates": short}


def collisions_report(review: Review) -> dict:
    hubs = surfaces.hubs(review._surfaces(), review.options.hub_limit)
    counts = _plain(surfaces.pointer_counts(review.pointers()), ["facet", "value"])
    return {
        **_frame("collisions", review), "collisions": _leads(review), **review.guards(), "hubs": hubs.count(), "hub_surfaces": review.guarded_hubs(review.options.leads), "pointer_counts": counts,
        "repository_context": review.repository.context, "repository_revision": review.repository.revision,
    }


def neighbors_report(review: Review, issue_id: str, limit: int, include_closed: bool) -> dict:
    return {**_frame("neighbors", review), "issue_id": issue_id, "neighbors": _plain(review.neighbours(issue_id, limit, include_closed), ["rank"])}


def relation_summary(review: Review) -> list[dict]:
    return _plain(relations.relation_accounting(review.edges, review.active.select("id")), [F.lit(1)])
