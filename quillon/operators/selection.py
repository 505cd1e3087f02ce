"""The bounded review queue, chosen in order under caps.

Whether a candidate is admitted depends on all admissions before it, of which the caps
allow only so many. Counters only grow, so who is refused once would be refused later
too: the fold takes a bounded run of the first candidates that no counter refuses yet,
then those that what it admitted still leaves open, until none are. Each run admits
one candidate at least, so the caps bound the runs, and their size is a parameter.

The fold notes when each counter was full. What that is for a candidate, its lane, the
run, its records and its target, decides its fate in one join with those times, of
which there are as many as admissions; all candidates that the fold never saw are
settled so.
"""

from __future__ import annotations

from collections import Counter, deque
from collections.abc import Callable
from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.model import ECHO, LANES, CandidatePolicy
from quillon.operators.qualify import ranking_key
from quillon.plans.ordering import numbered
from quillon.plans.staging import stage

DECISIONS = (
    "kind string, lane string, issue_id string, related_issue_id string, similarity double, admission_reason string, "
    "position long, stage string, decision string, drop_reason string, reserved boolean, backfill_for long"
)


def lane_reservations(limit: int, caps: dict[str, int]) -> dict[str, int]:
    """Least access of each lane to a queue of ``limit``: a fifth to each semantic lane."""
    fifth = max(1, limit // 5)
    asked = {1: (0, 0, 1), 2: (1, 0, 1)}.get(limit, (limit - 2 * fifth, fifth, fifth))
    return {lane: min(n, caps[lane]) for lane, n in zip(LANES, asked, strict=True)}


NEVER = 1 << 62  # a time after every offer
_STAGE_BITS = 44  # of a time, below the number of its pass


class Fold:
    """Caps and counters of one run, and the time of the offer that filled each."""

    def __init__(self, policy: CandidatePolicy) -> None:
        self.policy, self.caps = policy, policy.lane_caps
        self.per_record = {"dependency": policy.max_dependencies_per_issue, "semantic": policy.max_per_issue}
        self.taken, self.lanes, self.reserved = 0, Counter(), Counter()
        self.records, self.targets = Counter(), Counter()
        self.full = {("lane", lane): -1 for lane, cap in self.caps.items() if cap <= 0}

    def offer(self, row, time: int, reserved: bool) -> bool:
        """Admit the candidate offered at ``time``, unless a counter is full."""
        group = "dependency" if row.lane == "dependency" else "semantic"
        ends = [(group, row.issue_id), (group, row.related_issue_id)]
        asked = [("lane", row.lane), ("run", ""), *ends]
        if row.lane == "echo" and row.kind == ECHO:
            asked += [("echo", row.issue_id), ("target", row.related_issue_id)]
            if self.policy.max_echoes_per_target <= 0:
                return False
        if self.per_record[group] <= 0 or any(name in self.full for name in asked):
            return False
        self.taken += 1
        self.lanes[row.lane] += 1
        self.reserved[row.lane] += reserved
        self.records.update(ends)
        filled = {("lane", row.lane): self.lanes[row.lane] >= self.caps[row.lane], ("run", ""): self.taken >= self.policy.max_total}
        filled |= {end: self.records[end] >= self.per_record[group] for end in ends}
        if row.lane == "echo":
            self.targets[row.related_issue_id] += 1
            filled |= {("echo", row.issue_id): True, ("target", row.related_issue_id): self.targets[row.related_issue_id] >= self.policy.max_echoes_per_target}
        self.full |= {name: time for name, now in filled.items() if now and name not in self.full}
        return True

    def closed(self) -> bool:
        return ("run", "") in self.full or all(("lane", lane) in self.full for lane in self.caps)

    def times(self, spark: SparkSession) -> DataFrame:
        """``counter, name, full``: a row for each counter that is full, a few for each admission."""
        rows = [(counter, name, time) for (counter, name), time in self.full.items() if counter not in ("lane", "run")]
        return spark.createDataFrame(rows, "counter string, name string, full long")


def _refusals(rows: DataFrame, fold: Fold) -> DataFrame:
    """``rows`` with the first limit that each meets at its ``time``, as ``drop_reason``.

    The times of a fold are as many as its caps allow, so they are broadcast.
    """
    policy, times = fold.policy, fold.times(rows.sparkSession)
    out, full = rows, {}
    for end in ("issue_id", "related_issue_id"):
        counters = ("dependency", "semantic", "echo" if end == "issue_id" else "target")
        of = lambda c: F.min(F.when(F.col("counter") == c, F.col("full")))
        own = times.groupBy(F.col("name").alias(end)).agg(*[of(c).alias(f"_{c}_{end}") for c in counters])
        out = out.join(F.broadcast(own), end, "left")
        full |= {f"{c}_{end}": F.coalesce(f"_{c}_{end}", F.lit(NEVER)) for c in counters}
    dependency, echo = F.col("lane") == "dependency", (F.col("lane") == "echo") & (F.col("kind") == ECHO)
    time, lane_full = F.col("time"), F.lit(NEVER)
    for lane in LANES:
        lane_full = F.when(F.col("lane") == lane, fold.full.get(("lane", lane), NEVER)).otherwise(lane_full)
    records = {g: F.least(full[f"{g}_issue_id"], full[f"{g}_related_issue_id"]) if cap > 0 else F.lit(-1) for g, cap in fold.per_record.items()}
    reason = (
        F.when(time > lane_full, "lane-cap")
        .when(time > fold.full.get(("run", ""), NEVER), "run-cap")
        .when(echo & (time > full["echo_issue_id"]), "one-echo-per-active")
        .when(echo & ((time > full["target_related_issue_id"]) if policy.max_echoes_per_target > 0 else F.lit(True)), "completed-target-cap")
        .when(dependency & (time > records["dependency"]), "dependency-per-issue-cap")
        .when(~dependency & (time > records["semantic"]), "per-issue-cap")
    )
    return out.withColumn("drop_reason", reason).select(*rows.columns, "drop_reason")


def _fill(fold: Fold, rows: DataFrame, number: int, run: int, reserved_for: str | None = None) -> int:
    """Offer the rows in order; the position after which none was offered any more.

    Reads the first ``run`` that are open, again and again. A reserved share ends its
    pass as soon as its lane has it.
    """
    at, share = 0, (fold.policy.lane_reservations or {}).get(reserved_for, 0)
    while not fold.closed() and (reserved_for is None or fold.reserved[reserved_for] < share):
        later = rows.filter(F.col("position") > at).withColumn("time", F.lit(NEVER - 1))
        some = _refusals(later, fold).filter("drop_reason IS NULL").orderBy("position").limit(run).collect()
        for row in some:
            fold.offer(row, (number << _STAGE_BITS) | row.position, reserved_for is not None)
            at = row.position
            if reserved_for is not None and fold.reserved[reserved_for] >= share:
                return at
        if len(some) < run:
            break
    return (1 << _STAGE_BITS) - 1 if reserved_for is None or fold.reserved[reserved_for] < share else at


def select_candidates(requested: DataFrame, policy: CandidatePolicy, baseline: DataFrame | None = None, run: int | None = None) -> DataFrame:
    """Every candidate with its decision and its place in selection order.

    ``baseline`` candidates (those of the default thresholds) are offered before
    the others, so looser thresholds never push one out. With lane reservations
    each stage first fills every lane's share, then offers the rest in order.
    ``run`` is how many candidates the fold reads at a time.
    """
    keys, spark = ["kind", "issue_id", "related_issue_id"], requested.sparkSession
    named = F.lit("requested")
    rows = requested
    if baseline is not None:
        marked = baseline.select(*keys).distinct().withColumn("protected", F.lit(True))
        extra = baseline.join(requested.select(*keys), keys, "left_anti").withColumn("protected", F.lit(True))
        rows = rows.join(marked, keys, "left").unionByName(extra)
        named = F.when(F.col("protected"), "baseline").otherwise("addition")
    rows = rows.select("kind", "lane", "issue_id", "related_issue_id", "similarity", "admission_reason", "signal_quality", named.alias("stage"))
    place = [F.when(F.col("stage") == "addition", 1).otherwise(0).asc(), *ranking_key()]
    ordered = stage(numbered(rows, place), "ordered-candidates")

    fold, run = Fold(policy), run or 1000 + 4 * policy.max_total
    time, number = F.lit(None).cast("long"), 0
    passes = LANES if policy.lane_reservations else ()
    for name in ("requested",) if baseline is None else ("baseline", "addition"):
        own, rest = ordered.filter(F.col("stage") == name), F.lit(True)
        for lane in passes:
            upto = _fill(fold, own.filter(F.col("lane") == lane), number, run, lane)
            inside = (F.col("stage") == name) & (F.col("lane") == lane) & (F.col("position") <= upto)
            time, rest = F.when(inside, F.lit(number << _STAGE_BITS) + F.col("position")).otherwise(time), rest & ~inside
            number += 1
        _fill(fold, own.filter(rest), number, run)
        time = F.when((F.col("stage") == name) & rest, F.lit(number << _STAGE_BITS) + F.col("position")).otherwise(time)
        number += 1

    in_pass = F.shiftright(F.col("time"), _STAGE_BITS) % (len(passes) + 1) < len(passes)
    settled = _refusals(ordered.withColumn("time", time), fold).withColumn("reserved", F.col("drop_reason").isNull() & in_pass)
    admitted = F.col("drop_reason").isNull()
    waited = F.broadcast(fold.times(spark).filter("counter = 'echo'").select(F.col("name").alias("issue_id")))
    waited = settled.filter("drop_reason = 'completed-target-cap'").join(waited, "issue_id").groupBy("issue_id").agg(F.count("*").alias("waited"))
    made = settled.join(F.broadcast(waited), "issue_id", "left")
    filled = F.when(admitted & (F.col("lane") == "echo"), F.coalesce("waited", F.lit(0))).otherwise(0).cast("long")
    decision = F.when(admitted, "admitted").otherwise("dropped")
    made = made.withColumns({"decision": decision, "backfill_for": filled})
    return made.select(*[part.split()[0] for part in DECISIONS.split(", ")])


def lane_metrics(decisions: DataFrame) -> DataFrame:
    """Counts of decisions by lane, and over all lanes under ``all``."""
    admitted = F.col("decision") == "admitted"
    counts = [
        F.count("*").alias("qualified"),
        F.count_if(admitted).alias("admitted"),
        F.count_if(admitted & (F.col("stage") == "baseline")).alias("baseline_protected"),
        F.count_if(F.col("drop_reason") == "lane-cap").alias("dropped_by_lane_cap"),
        F.count_if(F.col("drop_reason").isin("one-echo-per-active", "per-issue-cap", "dependency-per-issue-cap")).alias("dropped_by_issue_cap"),
        F.count_if(F.col("drop_reason") == "completed-target-cap").alias("dropped_by_target_cap"),
        F.count_if(F.col("drop_reason") == "run-cap").alias("dropped_by_run_cap"),
    ]
    return decisions.rollup("lane").agg(*counts).withColumn("lane", F.coalesce("lane", F.lit("all")))


def echo_hubs(decisions: DataFrame) -> DataFrame:
    """Closed targets that met the target cap, with what became of their candidates."""
    echoes = decisions.filter((F.col("lane") == "echo") & (F.col("kind") == ECHO))
    reasons = ("completed-target-cap", "one-echo-per-active", "per-issue-cap", "lane-cap", "run-cap")
    counts = [F.count_if(F.col("drop_reason") == r).alias("omitted_" + r.replace("-", "_")) for r in reasons]
    rows = echoes.groupBy("related_issue_id").agg(F.count("*").alias("qualified"), F.count_if(F.col("decision") == "admitted").alias("admitted"), *counts)
    return rows.filter("omitted_completed_target_cap > 0")


def capped_dependencies(decisions: DataFrame, candidates: DataFrame) -> DataFrame:
    """Typed relations of candidates that a dependency limit or cap left out."""
    dropped = decisions.filter("drop_reason IN ('lane-cap', 'run-cap', 'dependency-per-issue-cap')").select("kind", "issue_id", "related_issue_id", "drop_reason")
    rows = candidates.filter("evidence_type IS NOT NULL").join(dropped, ["kind", "issue_id", "related_issue_id"])
    return rows.select("evidence_source", "evidence_target", "evidence_type", "drop_reason")


class ConservationError(ValueError):
    """The dependency funnel lost or made relations; carries counts, never content."""

    def __init__(self, stage: str, balance: dict, counts: dict[str, int]) -> None:
        parts = ", ".join(f"{p['name']}={p['count']}" for p in (balance["input"], *balance["parts"]))
        super().__init__(f"typed dependency {stage} funnel does not conserve ({parts}, unaccounted={balance['unaccounted']})")
        self.receipt = {"code": "typed-dependency-conservation-failed", "lane": "dependency", "stage": stage, "balance": balance, "counts": counts}


#: Each stage of the funnel: what goes in, and the sums that must come out.
ACCOUNTS = (
    ("discovery", "total_non_parent_typed", {"excluded": ("inactive_or_closed_only", "below_qualification"), "eligible": ("eligible",)}),
    ("edge-to-candidate", "eligible", {"eligible_candidates": ("eligible_candidates",), "coalesced_eligible_edges": ("coalesced_eligible_edges",)}),
    ("admission", "eligible_candidates", {"admitted": ("admitted",), "omitted": ("omitted_by_per_issue_cap", "omitted_by_lane_cap", "omitted_by_run_cap")}),
)


def dependency_accounts(funnel: DataFrame, decisions: DataFrame) -> dict[str, int]:
    """Counts of the funnel's one row and of what selection did with the dependency lane."""
    reasons = {"omitted_by_per_issue_cap": "dependency-per-issue-cap", "omitted_by_lane_cap": "lane-cap", "omitted_by_run_cap": "run-cap"}
    counted = [F.count_if(F.col("drop_reason") == r).alias(k) for k, r in reasons.items()]
    row = decisions.filter("lane = 'dependency'").agg(F.count_if(F.col("decision") == "admitted").alias("admitted"), *counted).first()
    return {**{k: v for k, v in funnel.first().asDict().items() if k != "unaccounted"}, **row.asDict()}


def check_accounts(counts: dict[str, int]) -> dict[str, int]:
    """The counts, if each stage of the funnel gives out what went in."""
    for stage, name, parts in ACCOUNTS:
        sums = [{"name": part, "count": sum(counts[c] for c in columns)} for part, columns in parts.items()]
        missing = counts[name] - sum(p["count"] for p in sums)
        if missing:
            raise ConservationError(stage, {"input": {"name": name, "count": counts[name]}, "parts": sums, "unaccounted": missing}, counts)
    return counts


def with_degradation(run: Callable[[CandidatePolicy], DataFrame], policy: CandidatePolicy) -> tuple[DataFrame, dict | None]:
    """The run, or where its dependency accounts do not balance the run without that lane and a receipt."""
    try:
        return run(policy), None
    except ConservationError as error:
        wanted = (frozenset({"overlap", "echo"}) if policy.objectives is None else policy.objectives) - {"structure"}
        reserved = policy.lane_reservations and {**policy.lane_reservations, "dependency": 0}
        rows = run(replace(policy, objectives=wanted, max_dependencies=0, lane_reservations=reserved))
        return rows, {**error.receipt, "degraded_lanes": ["dependency"], "retained_lanes": [lane for lane in ("echo", "overlap") if lane in wanted]}


@dataclass(frozen=True, order=True)
class Chosen:
    """A candidate of a bounded queue, for comparing two queues on the driver."""

    kind: str
    issue_id: str
    related_issue_id: str
    lane: str = field(default="", compare=False)

    @property
    def resources(self) -> set[str]:
        """Keys of everything that the candidate could share with another."""
        echo = {f"target:{self.related_issue_id}", f"one:{self.issue_id}"} if self.kind == ECHO else set()
        return {f"{self.budget}:{end}" for end in self.ends} | echo | {f"lane:{self.lane}", "run"}

    @property
    def name(self) -> str:
        return f"{self.kind}|{self.issue_id}|{self.related_issue_id}"

    @property
    def ends(self) -> frozenset[str]:
        return frozenset((self.issue_id, self.related_issue_id))

    @property
    def budget(self) -> str:
        return "dependency" if self.lane == "dependency" else "semantic"


class Usage:
    """How much of each cap a queue has used."""

    def __init__(self, queue: list[Chosen], policy: CandidatePolicy) -> None:
        self.policy, self.total = policy, len(queue)
        self.lanes = Counter(c.lane for c in queue)
        self.ends = Counter((c.budget, end) for c in queue for end in c.ends)
        self.targets = Counter(c.related_issue_id for c in queue if c.kind == ECHO)

    def end_is_full(self, c: Chosen, end: str) -> bool:
        cap = self.policy.max_dependencies_per_issue if c.budget == "dependency" else self.policy.max_per_issue
        return self.ends[c.budget, end] >= cap

    def lane_is_full(self, lane: str) -> bool:
        return self.lanes[lane] >= self.policy.lane_caps[lane]

    def governing(self, new: Chosen, displaced: list[Chosen]) -> str | None:
        """The cap that kept ``new`` out of the queue that this is the usage of."""
        echoes = [d for d in displaced if d.kind == ECHO] if new.kind == ECHO else []
        if any(d.related_issue_id == new.related_issue_id for d in echoes):
            return "max-echoes-per-target"
        if any(d.issue_id == new.issue_id for d in echoes):
            return "one-echo-per-active-record"
        if any(self.end_is_full(new, end) for end in new.ends):
            return "max-dependencies-per-issue" if new.budget == "dependency" else "max-candidates-per-issue"
        if self.lane_is_full(new.lane):
            return f"lane-cap:{new.lane}"
        return "run-cap" if self.total >= self.policy.max_total else None

    def shared(self, a: Chosen, b: Chosen) -> str | None:
        """A used-up resource that both draw on."""
        if a.budget == b.budget:
            for end in sorted(a.ends & b.ends):
                if self.end_is_full(a, end):
                    return f"{a.budget}-issue:{end}"
        if a.kind == b.kind == ECHO:
            if a.related_issue_id == b.related_issue_id and self.targets[a.related_issue_id] >= self.policy.max_echoes_per_target:
                return f"echo-target:{a.related_issue_id}"
            if a.issue_id == b.issue_id:
                return f"one-echo:{a.issue_id}"
        if a.lane == b.lane and self.lane_is_full(a.lane):
            return f"lane:{a.lane}"
        return "run" if self.total >= self.policy.max_total else None


def _chain(new: Chosen, nodes: list[Chosen], removed: list[Chosen], displaced: set[Chosen], introduced: set[Chosen], usage: Usage, cap: str) -> list[dict[str, str]]:
    """Shortest way over shared resources from a lost qualification to the admission."""
    goals, came, waiting = set(removed), {new: None}, deque([new])
    end = new if new in goals else None
    while waiting and end is None:
        here = waiting.popleft()
        for node in nodes:
            if node in came:
                continue
            resource = usage.shared(here, node)
            if resource is None:
                continue
            came[node] = (here, resource)
            if node in goals:
                end = node
                break
            waiting.append(node)
    if end is None:
        lost = min(removed, key=lambda c: c.name)
        return [{"candidate_id": c.name, "event": e, "resource": f"governing-cap:{cap}"} for c, e in ((lost, "qualification-removed"), (new, "selection-admitted"))]
    out, node, resource = [], end, f"governing-cap:{cap}"
    while node is not None:
        link = came[node]
        resource = link[1] if link else resource
        event = "qualification-removed" if not out else "selection-admitted" if node in introduced else "selection-displaced" if node in displaced else "selection-transition"
        out.append({"candidate_id": node.name, "event": event, "resource": resource})
        node = link[0] if link else None
    return out


def cap_replacements(reference: list[Chosen], strict: list[Chosen], reference_qualified: list[Chosen], strict_qualified: list[Chosen], policy: CandidatePolicy) -> list[dict]:
    """Admissions that stricter thresholds bring in, each with its cap, what it displaced and why.

    Of the qualified ones only those that the stricter thresholds remove matter.
    """
    introduced, displaced = sorted(set(strict) - set(reference)), sorted(set(reference) - set(strict))
    removed = sorted(set(reference_qualified) - set(strict_qualified))
    usage = Usage(reference, policy)
    nodes, out = sorted({*removed, *displaced, *introduced}), []
    for new in introduced:
        cap = usage.governing(new, displaced)
        if cap is None:
            continue
        if not removed:
            raise ValueError("a replacement without a lost qualification")
        wide = cap in ("run-cap", f"lane-cap:{new.lane}")
        touched = [
            d.name
            for d in displaced
            if (cap == "max-candidates-per-issue" and d.budget == "semantic" and new.ends & d.ends) or (d.lane == new.lane and (wide or new.ends & d.ends))
        ]
        chain = _chain(new, nodes, removed, set(displaced), set(introduced), usage, cap)
        out.append({"candidate_id": new.name, "governing_cap": cap, "displaced": sorted(touched), "causal_chain": chain})
    return sorted(out, key=lambda d: d["candidate_id"])


REPLACEMENTS = "candidate_id string, governing_cap string, displaced array<string>, causal_chain array<struct<candidate_id:string,event:string,resource:string>>"


def _nearest_lost(lost: DataFrame, queue: list[Chosen]) -> list[Chosen]:
    """Of the lost qualifications the first for each resource that the queues touch.

    A chain ends at the first lost one that shares a resource with its last link,
    so no other can occur in it; what comes to the driver is bounded by the queues.
    """
    spark, echo = lost.sparkSession, F.col("kind") == ECHO
    budget = F.when(F.col("lane") == "dependency", "dependency:").otherwise("semantic:")
    keys = F.array(
        F.concat(budget, "issue_id"), F.concat(budget, "related_issue_id"), F.when(echo, F.concat(F.lit("target:"), "related_issue_id")),
        F.when(echo, F.concat(F.lit("one:"), "issue_id")), F.concat(F.lit("lane:"), "lane"), F.lit("run"),
    )
    touched = spark.createDataFrame([(k,) for k in sorted({"run"}.union(*(c.resources for c in queue)))], "key string")
    row = F.struct("kind", "issue_id", "related_issue_id", "lane")
    near = lost.select(row.alias("c"), F.explode(keys).alias("key")).join(F.broadcast(touched), "key", "left_semi").groupBy("key").agg(F.min("c").alias("c"))
    first = lost.agg(F.min(F.struct(F.concat_ws("|", "kind", "issue_id", "related_issue_id").alias("name"), row.alias("c"))).alias("m")).select(F.col("m.c").alias("c"))
    return [Chosen(*r.c) for r in near.select("c").unionByName(first).collect() if r.c is not None]


def replacements(reference: DataFrame, strict: DataFrame, policy: CandidatePolicy) -> DataFrame:
    """``cap_replacements`` of two tables of decisions, in which each qualified candidate has one."""
    keys = ["kind", "issue_id", "related_issue_id"]
    admitted = lambda rows: [Chosen(*r) for r in rows.filter("decision = 'admitted'").select(*keys, "lane").distinct().collect()]
    before, after = admitted(reference), admitted(strict)
    lost = reference.select(*keys, "lane").join(strict.select(*keys), keys, "left_anti")
    rows = cap_replacements(before, after, _nearest_lost(lost, before + after), [], policy)
    return reference.sparkSession.createDataFrame([tuple(r.values()) for r in rows], REPLACEMENTS)
