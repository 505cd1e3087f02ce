"""The selection fold on golden cases and by its invariants."""

import random
from collections import Counter

import pytest

from quillon.model import ECHO, OVERLAP, CandidatePolicy
from quillon.operators import selection

COLUMNS = "kind string, lane string, issue_id string, related_issue_id string, similarity double, admission_reason string, signal_quality string"


def frame(spark, rows, kind=ECHO, lane="echo"):
    return spark.createDataFrame([(kind, lane, a, b, s, "semantic-threshold", "semantic") for a, b, s in rows], COLUMNS)


def admitted(decisions):
    return [(r.issue_id, r.related_issue_id) for r in decisions.orderBy("position").collect() if r.decision == "admitted"]


def test_target_cap_and_backfill(spark):
    rows = [("A", "X", 0.99), ("A", "Y", 0.81), ("B", "X", 0.98), ("B", "Y", 0.82), ("C", "X", 0.97), ("C", "Y", 0.96), ("D", "Z", 0.95)]
    policy = CandidatePolicy(echo_threshold=0.8, overlap_threshold=0.8, max_per_issue=10, max_total=4)
    decisions = selection.select_candidates(frame(spark, rows), policy).cache()
    assert admitted(decisions) == [("A", "X"), ("B", "X"), ("C", "Y"), ("D", "Z")]
    hub = selection.echo_hubs(decisions).collect()
    assert [(r.related_issue_id, r.qualified, r.admitted, r.omitted_completed_target_cap) for r in hub] == [("X", 3, 2, 1)]
    assert [(r.issue_id, r.backfill_for) for r in decisions.filter("backfill_for > 0").collect()] == [("C", 1)]


def test_hub_omissions_by_reason(spark):
    rows = [("A", "Y", 0.99), ("A", "X", 0.98), ("B", "X", 0.97), ("C", "X", 0.96), ("D", "X", 0.95), ("D", "Y", 0.94)]
    policy = CandidatePolicy(echo_threshold=0.8, overlap_threshold=0.8, max_per_issue=10, max_total=20)
    hubs = {r.related_issue_id: r for r in selection.echo_hubs(selection.select_candidates(frame(spark, rows), policy)).collect()}
    x = hubs["X"]
    assert (x.qualified, x.admitted, x.omitted_completed_target_cap, x.omitted_one_echo_per_active) == (4, 2, 1, 1)


def test_invariants_and_metrics(spark):
    rng = random.Random(2)
    ids = [f"r{k}" for k in range(30)]
    rows = [(*rng.sample(ids, 2), round(rng.random(), 3)) for _ in range(300)]
    rows = list({(a, b): (a, b, s) for a, b, s in rows}.values())
    parts = [frame(spark, rows[:100], OVERLAP, "overlap"), frame(spark, rows[100:200]), frame(spark, rows[200:], OVERLAP, "dependency")]
    candidates = parts[0].unionByName(parts[1]).unionByName(parts[2])
    policy = CandidatePolicy(max_total=40, max_per_issue=3, max_dependencies=12, lane_reservations={"dependency": 5, "echo": 10, "overlap": 10})
    got = selection.select_candidates(candidates, policy).collect()
    chosen = [r for r in got if r.decision == "admitted"]
    assert len(got) == len(rows) and len(chosen) <= 40
    assert Counter(r.lane for r in chosen)["dependency"] <= 12
    for lanes in (("dependency",), ("echo", "overlap")):
        ends = Counter(e for r in chosen if r.lane in lanes for e in (r.issue_id, r.related_issue_id))
        assert max(ends.values()) <= 3
    assert max(Counter(r.related_issue_id for r in chosen if r.lane == "echo").values()) <= 2
    total = {r.lane: r for r in selection.lane_metrics(selection.select_candidates(candidates, policy)).collect()}["all"]
    drops = total.dropped_by_lane_cap + total.dropped_by_issue_cap + total.dropped_by_target_cap + total.dropped_by_run_cap
    assert total.qualified == total.admitted + drops == len(rows)


def test_baseline_is_never_displaced(spark):
    base = [("A", "X", 0.9), ("B", "Y", 0.85)]
    more = base + [("A", "Y", 0.99), ("C", "X", 0.98), ("D", "X", 0.97)]
    policy = CandidatePolicy(echo_threshold=0.3, overlap_threshold=0.3, max_total=3)
    decisions = selection.select_candidates(frame(spark, more), policy, frame(spark, base))
    assert set(base_pair[:2] for base_pair in base) <= set(admitted(decisions))


def test_policy_is_checked():
    for bad in ({"echo_threshold": 2.0}, {"max_total": 0}, {"exception_margin": -1.0}, {"lane_reservations": {"echo": 1}}, {"objectives": frozenset({"x"})}):
        with pytest.raises(ValueError):
            CandidatePolicy(**bad)
    assert selection.lane_reservations(20, CandidatePolicy().lane_caps) == {"dependency": 12, "echo": 4, "overlap": 4}


def by_hand(rows, policy, baseline=()):
    """The queue offer by offer: (decision, reason, reserved, backfills) of every candidate in order."""
    caps, protected = policy.lane_caps, set(baseline)
    lanes, ends, targets, waiting, reserved, echo_of = Counter(), Counter(), Counter(), Counter(), Counter(), set()
    out, lane_rank = {}, {"dependency": 0, "echo": 1, "overlap": 2}
    order = sorted(rows, key=lambda r: (bool(baseline) and r[:4] not in protected, lane_rank[r[1]], -r[4], r[0], r[2], r[3]))

    def offer(r, held):
        kind, lane, a, b, _ = r
        group = "dependency" if lane == "dependency" else "semantic"
        cap, echo = (policy.max_dependencies_per_issue if group == "dependency" else policy.max_per_issue), lane == "echo" and kind == ECHO
        reason = None
        if lanes[lane] >= caps[lane]:
            reason = "lane-cap"
        elif sum(lanes.values()) >= policy.max_total:
            reason = "run-cap"
        elif echo and a in echo_of:
            reason = "one-echo-per-active"
        elif echo and targets[b] >= policy.max_echoes_per_target:
            reason = "completed-target-cap"
            waiting[a] += 1
        elif max(ends[group, a], ends[group, b]) >= cap:
            reason = "dependency-per-issue-cap" if group == "dependency" else "per-issue-cap"
        if reason:
            out[r] = ("dropped", reason, False, 0)
            return
        lanes[lane] += 1
        reserved[lane] += held
        ends.update([(group, a), (group, b)])
        if lane == "echo":
            echo_of.add(a)
            targets[b] += 1
        out[r] = ("admitted", None, held, waiting.pop(a, 0) if lane == "echo" else 0)

    for part in (True, False):
        own = [r for r in order if (not baseline or r[:4] in protected) == part]
        for lane in lane_rank if policy.lane_reservations else ():
            for r in own:
                if reserved[lane] >= policy.lane_reservations[lane]:
                    break
                if r[1] == lane:
                    offer(r, True)
        for r in own:
            if r not in out:
                offer(r, False)
    return [(r[:4], *out[r]) for r in order]


@pytest.mark.parametrize(("seed", "run"), [(1, None), (2, 3), (3, 1), (4, 7)])
def test_runs_and_settling_equal_offering_one_by_one(spark, seed, run):
    rng = random.Random(seed)
    rows = set()
    for _ in range(260):
        lane = rng.choice(["dependency", "echo", "overlap"])
        kind = {"dependency": "typed", "echo": rng.choice([ECHO, ECHO, "other"]), "overlap": OVERLAP}[lane]
        rows.add((kind, lane, f"a{rng.randint(0, 25)}", f"b{rng.randint(0, 12)}", rng.randint(30, 99) / 100))
    rows = list({r[:4]: r for r in rows}.values())
    shares = {"dependency": 4, "echo": 2, "overlap": 3} if seed % 2 else None
    policy = CandidatePolicy(max_total=30, max_per_issue=3, max_echoes_per_target=2, max_dependencies_per_issue=2, max_dependencies=9, max_echoes=8, max_overlaps=14, lane_reservations=shares, echo_threshold=0.3, overlap_threshold=0.3)
    table = lambda own: spark.createDataFrame([(k, lane, a, b, s, "semantic-threshold", "semantic") for k, lane, a, b, s in own], COLUMNS)
    base = [r for r in rows if r[4] >= 0.7] if seed > 2 else None
    got = selection.select_candidates(table(rows), policy, table(base) if base else None, run).orderBy("position").collect()
    want = by_hand(rows, policy, [r[:4] for r in base] if base else ())
    assert [r.position for r in got] == list(range(1, len(rows) + 1))
    assert [((r.kind, r.lane, r.issue_id, r.related_issue_id), r.decision, r.drop_reason, r.reserved, r.backfill_for) for r in got] == want


def test_what_the_fold_reads_is_bound_by_the_caps(spark, monkeypatch):
    offered, offer = [], selection.Fold.offer
    monkeypatch.setattr(selection.Fold, "offer", lambda self, row, *a: offered.append(row) or offer(self, row, *a))
    rows = [(f"a{k % 5}", f"b{k}", 0.9 - k / 1e6) for k in range(20_000)]
    got = selection.select_candidates(frame(spark, rows, OVERLAP, "overlap"), CandidatePolicy(max_total=10, max_per_issue=2, max_overlaps=10), run=50)
    counts = {r.drop_reason: r["count"] for r in got.groupBy("drop_reason").count().collect()}
    assert counts == {None: 10, "lane-cap": 19_990} and len(offered) <= 100


def test_capped_dependencies_look_at_related_pairs_only(spark, sf_dir):
    """With a margin that admits every pair, only typed relations are made into candidates; the decisions are those of the whole run."""
    from quillon import catalog

    policy = CandidatePolicy(echo_threshold=0.3, overlap_threshold=0.3, exception_margin=1.0, max_dependencies=5)
    few, decided = catalog._decisions(spark, sf_dir, policy, related_only=True)
    whole, all_decided = catalog._decisions(spark, sf_dir, policy)
    typed = lambda rows: {(r.kind, r.issue_id, r.related_issue_id) for r in rows.filter("evidence_type IS NOT NULL").collect()}
    assert few.count() == len(typed(few)) and typed(few) == typed(whole) and whole.count() > few.count()
    lane = lambda rows: {(r.kind, r.issue_id, r.related_issue_id, r.decision, r.drop_reason) for r in rows.filter("lane = 'dependency'").collect()}
    assert lane(decided) == lane(all_decided)
