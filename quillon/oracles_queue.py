"""The bounded queue in SQL: the ordered fold as a recursion of one step for each offer."""

from __future__ import annotations

from quillon.model import LANES, CandidatePolicy
from quillon.oracles import _KEY, _qualified

_COUNT = "len(list_filter({}, lambda x: x = {}))"


def _rows(policy: CandidatePolicy) -> str:
    objectives = None if policy.objectives is None else tuple(policy.objectives)
    return _qualified(policy.echo_threshold, policy.overlap_threshold, policy.exception_margin, objectives, alternatives=policy.max_echo_alternatives_per_active)


def _reason(policy: CandidatePolicy) -> str:
    caps = policy.lane_caps
    lane = " ".join(f"WHEN '{name}' THEN n_{name} >= {caps[name]}" for name in LANES)
    echo = "lane = 'echo' AND kind = 'completed-work-echo'"
    used = "greatest(" + ", ".join(_COUNT.format("ends", f"budget || {end}") for end in ("issue_id", "related_issue_id")) + ")"
    return f"""CASE WHEN CASE lane {lane} END THEN 'lane-cap' WHEN taken >= {policy.max_total} THEN 'run-cap'
    WHEN {echo} AND list_contains(firsts, issue_id) THEN 'one-echo-per-active'
    WHEN {echo} AND {_COUNT.format('targets', 'related_issue_id')} >= {policy.max_echoes_per_target} THEN 'completed-target-cap'
    WHEN lane = 'dependency' AND {used} >= {policy.max_dependencies_per_issue} THEN 'dependency-per-issue-cap'
    WHEN lane <> 'dependency' AND {used} >= {policy.max_per_issue} THEN 'per-issue-cap' END"""


def decisions(policy: CandidatePolicy, baseline: CandidatePolicy | None = None) -> str:
    """``WITH RECURSIVE`` up to ``settled``, as ``select_candidates`` gives them."""
    keys = "(kind, issue_id, related_issue_id)"
    staged = "staged AS (SELECT *, 'requested' AS stage FROM qualified)"
    if baseline is not None:
        staged = f"""base AS MATERIALIZED (WITH {_rows(baseline)} SELECT * FROM qualified),
staged AS (SELECT *, CASE WHEN {keys} IN (SELECT {keys} FROM base) THEN 'baseline' ELSE 'addition' END AS stage FROM qualified
  UNION ALL SELECT *, 'baseline' FROM base WHERE {keys} NOT IN (SELECT {keys} FROM qualified))"""
    quota = policy.lane_reservations
    phases = ", ".join([f"({k}, '{name}')" for k, name in enumerate(LANES) if quota] + ["(3, NULL)"])
    filled = " ".join(f"WHEN '{name}' THEN r_{name} >= {quota[name]}" for name in LANES) if quota else "WHEN '' THEN true"
    counts = ", ".join(f"n_{name} + (ok AND lane = '{name}')::int, r_{name} + (ok AND phase < 3 AND lane = '{name}')::int" for name in LANES)
    names = ", ".join(f"n_{name}, r_{name}" for name in LANES)
    return f"""WITH RECURSIVE {_rows(policy)}, {staged},
ordered AS MATERIALIZED (SELECT kind, lane, issue_id, related_issue_id, similarity, admission_reason, stage, CASE WHEN lane = 'dependency' THEN 'd:' ELSE 's:' END AS budget,
  row_number() OVER (ORDER BY (stage = 'addition')::int, {_KEY}) AS position FROM staged),
offers AS MATERIALIZED (SELECT o.*, phase, row_number() OVER (ORDER BY (stage = 'addition')::int, phase, position) AS step FROM ordered o JOIN (VALUES {phases}) p(phase, only_lane) ON only_lane IS NULL OR only_lane = lane),
fold(step, position, reason, backfill, held, taken, {names}, ends, firsts, targets, waiting, done) AS (
  SELECT 0::bigint, NULL::bigint, NULL::varchar, 0, false, 0, 0, 0, 0, 0, 0, 0, []::varchar[], []::varchar[], []::varchar[], []::varchar[], []::bigint[]
  UNION ALL
  SELECT step, CASE WHEN NOT skipped THEN spot END, CASE WHEN NOT skipped THEN why END, CASE WHEN ok AND lane = 'echo' THEN {_COUNT.format('waiting', 'issue_id')} ELSE 0 END, ok AND phase < 3, taken + ok::int, {counts},
    CASE WHEN ok THEN ends || [budget || issue_id, budget || related_issue_id] ELSE ends END, CASE WHEN ok AND lane = 'echo' THEN firsts || [issue_id] ELSE firsts END,
    CASE WHEN ok AND lane = 'echo' THEN targets || [related_issue_id] ELSE targets END,
    CASE WHEN ok AND lane = 'echo' THEN list_filter(waiting, lambda x: x <> issue_id) WHEN NOT skipped AND why = 'completed-target-cap' THEN waiting || [issue_id] ELSE waiting END,
    CASE WHEN phase < 3 AND NOT skipped THEN done || [spot] ELSE done END
  FROM (SELECT *, NOT skipped AND why IS NULL AS ok FROM (
    SELECT f.* EXCLUDE (step, position), o.step, o.position AS spot, phase, lane, kind, issue_id, related_issue_id, budget,
      CASE WHEN phase < 3 THEN CASE lane {filled} END ELSE list_contains(done, o.position) END AS skipped, {_reason(policy)} AS why
    FROM fold f JOIN offers o ON o.step = f.step + 1))),
settled AS (SELECT kind, lane, issue_id, related_issue_id, similarity, admission_reason, position, stage, CASE WHEN reason IS NULL THEN 'admitted' ELSE 'dropped' END AS decision,
  reason AS drop_reason, held AS reserved, backfill::bigint AS backfill_for FROM fold JOIN ordered USING (position))"""


def queries() -> dict[str, str]:
    from quillon import catalog as c

    capped = CandidatePolicy(echo_threshold=0.3, overlap_threshold=0.3, exception_margin=1.0, max_dependencies=5)
    loose = CandidatePolicy(echo_threshold=0.3, overlap_threshold=0.3, max_total=60)
    admitted = "decision = 'admitted'"
    lane = f"""count(*) AS qualified, count(*) FILTER ({admitted}) AS admitted, count(*) FILTER ({admitted} AND stage = 'baseline') AS baseline_protected, count(*) FILTER (drop_reason = 'lane-cap') AS dropped_by_lane_cap,
  count(*) FILTER (drop_reason IN ('one-echo-per-active', 'per-issue-cap', 'dependency-per-issue-cap')) AS dropped_by_issue_cap, count(*) FILTER (drop_reason = 'completed-target-cap') AS dropped_by_target_cap, count(*) FILTER (drop_reason = 'run-cap') AS dropped_by_run_cap"""
    reasons = ("completed-target-cap", "one-echo-per-active", "per-issue-cap", "lane-cap", "run-cap")
    omitted = ", ".join(f"count(*) FILTER (drop_reason = '{r}') AS omitted_{r.replace('-', '_')}" for r in reasons)
    ids = "(SELECT kind, issue_id, related_issue_id FROM settled WHERE decision = 'admitted')"
    return {
        "sel1_selection": decisions(c.POLICY) + " SELECT * FROM settled",
        "sel2_baseline_protection": decisions(loose, c.POLICY) + " SELECT * FROM settled",
        "sel3_reservations": decisions(c.TIGHT) + " SELECT * FROM settled",
        "sel4_backfills": decisions(c.ECHOES) + " SELECT issue_id, related_issue_id, backfill_for FROM settled WHERE backfill_for > 0",
        "sel5_capped_dependencies": decisions(capped) + " SELECT evidence_source, evidence_target, evidence_type, drop_reason FROM settled JOIN qualified q USING (kind, issue_id, related_issue_id) WHERE drop_reason IN ('lane-cap', 'run-cap', 'dependency-per-issue-cap') AND evidence_type IS NOT NULL",
        "agg8_lane_metrics": decisions(c.TIGHT) + f" SELECT coalesce(lane, 'all') AS lane, {lane} FROM settled GROUP BY ROLLUP (lane)",
        "agg9_echo_hubs": decisions(c.ECHOES) + f" SELECT related_issue_id, count(*) AS qualified, count(*) FILTER ({admitted}) AS admitted, {omitted} FROM settled WHERE lane = 'echo' AND kind = 'completed-work-echo' GROUP BY 1 HAVING count(*) FILTER (drop_reason = 'completed-target-cap') > 0",
        "set6_displaced": f"WITH strict AS MATERIALIZED ({decisions(c.POLICY)} SELECT * FROM {ids}), loose AS MATERIALIZED ({decisions(c.TIGHT)} SELECT * FROM {ids}) SELECT kind, issue_id, related_issue_id, CASE WHEN s.kind IS NULL THEN 'introduced' WHEN l.kind IS NULL THEN 'displaced' ELSE 'kept' END AS change FROM strict s FULL JOIN loose l USING (kind, issue_id, related_issue_id)",
    }
