"""Queries of explanations, provenance, readers and review support, each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillon import oracles
from quillon.catalog import POLICY, STOP_WORDS, TIGHT, Inputs, Query, _decisions, _funnel, _lines, _pointers
from quillon.operators import anchors, evaluate, explain, relations, selection, surfaces
from quillon.operators import vectors as V
from quillon.plans.staging import stage
from quillon.sources import host_pages, records as R, trackers

_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}
QUALIFIED = "WITH " + oracles._qualified()
BASE = "WITH " + oracles._REC
EDGED = BASE + ", " + oracles._EDG


def query(name: str, sql: str | None = None):
    def add(f: Query) -> Query:
        _QUERIES[name] = f
        if sql is not None:
            _SQL[name] = sql
        return f

    return add


# --- explanations ----------------------------------------------------------------


def _explained(s: SparkSession, d: str) -> DataFrame:
    i = Inputs(s, d)
    rows = i.qualified().select("kind", "lane", "issue_id", "related_issue_id", "similarity", "structural_context")
    return explain.explain(rows, i.records, STOP_WORDS)


def _table(concepts: dict[str, str]) -> str:
    of: dict[str, str] = {}
    for name, words in concepts.items():
        for word in words.split():
            of.setdefault(word, name)
    return "MAP {" + ", ".join(f"'{k}': '{v}'" for k, v in of.items()) + "}"


def _any(tokens: str, words: str) -> str:
    return f"list_has_any({tokens}, {oracles._list(words.split())})"


def _explain_sql() -> str:
    """CTEs up to ``x``: pairs with evidence and anchors. Design and notes are empty in the tables."""
    fields = ("title", "description", "acceptance_criteria")
    label = {"title": "title", "description": "description", "acceptance_criteria": "acceptance criteria"}
    raw = lambda c: f"list_filter(regexp_extract_all(lower({c}), '[a-z0-9]+'), lambda t: length(t) >= 3 AND NOT list_contains({oracles._list(STOP_WORDS)}, t))"
    own = ", ".join(f"{raw(c)} AS {c}_all, list_distinct({raw(c)}) AS {c}" for c in fields)
    acts, ents = " ".join(anchors.ACTIONS.values()), " ".join(anchors.ENTITIES.values())
    score = lambda c: f"CASE WHEN len(a.{c}) = 0 OR len(b.{c}) = 0 THEN 0.0::double ELSE round(2.0::double * len(list_intersect(a.{c}, b.{c})) / (len(a.{c}) + len(b.{c})), 3) END"
    cols = ", ".join(f"a.{c} AS l_{c}, a.{c}_all AS l_{c}_all, b.{c} AS r_{c}, list_intersect(a.{c}, b.{c}) AS s_{c}, {score(c)} AS {c}_score" for c in fields)
    order = ("acceptance_criteria", "title", "description")
    full = lambda t: f"{_any(t, acts)} AND {_any(t, ents)}"
    source = "coalesce(" + ", ".join(
        [f"CASE WHEN {full('s_' + c)} THEN '{c}' END" for c in order] + [f"CASE WHEN {full('l_' + c)} THEN '{c}' END" for c in order] + [f"CASE WHEN l_{c}_text <> '' THEN '{c}' END" for c in order]
    ) + ")"
    everything = lambda p: " || ".join(f"{p}_{c}" for c in fields)
    both = lambda words: f"({_any(everything('l'), words)} AND {_any(everything('r'), words)})"
    at = lambda what: "CASE src " + " ".join(f"WHEN '{c}' THEN {what.format(c=c)}" for c in order) + " END"
    concept = lambda t: f"list_filter(list_transform(list_filter({at('l_{c}_all')}, lambda t: {t}[t] IS NOT NULL AND list_contains({at('s_{c}')}, t)), lambda t: {t}[t]), lambda n: n IS NOT NULL)[1]"
    checks = lambda p, give: "CASE " + " ".join(
        f"WHEN {_any(f'{p}_{c}', words)}{' AND own' if check == 'ownership-boundary' else ''} THEN '{check if give == 'check' else label[c]}'" for c in fields for check, words in anchors.CHECKS.items()
    ) + " END"
    names = "list_transform(list_sort(list_filter([" + ", ".join(f"{{'s': -{c}_score, 'k': {k}, 'f': '{label[c]}', 'n': len(s_{c})}}" for k, c in enumerate(fields)) + "], lambda e: e.n > 0)), lambda e: {'f': e.f, 's': -e.s})"
    return f"""{QUALIFIED}, own AS (SELECT id, parent_id, status, title AS title_text, description AS description_text, acceptance_criteria AS acceptance_criteria_text, {own} FROM records),
x1 AS (SELECT q.kind, q.lane, q.issue_id, q.related_issue_id, q.similarity, q.structural_context, coalesce(a.parent_id = q.related_issue_id OR b.parent_id = q.issue_id, false) AS fam,
  a.status AS l_status, b.status AS r_status, a.title_text AS l_title_text, a.description_text AS l_description_text, a.acceptance_criteria_text AS l_acceptance_criteria_text, b.acceptance_criteria_text AS r_acceptance_criteria_text, {cols}
  FROM qualified q JOIN own a ON a.id = q.issue_id JOIN own b ON b.id = q.related_issue_id),
x2 AS (SELECT *, {source} AS src, {both(anchors.OWNERSHIP)} AS own, {both(anchors.INVARIANT)} AS inv, {both(anchors.IMPLEMENTATION)} AS imp, {names} AS ev FROM x1),
x3 AS (SELECT *, {concept(_table(anchors.ACTIONS))} AS op, {concept(_table(anchors.ENTITIES))} AS en, {checks('l', 'check')} AS lc, {checks('r', 'check')} AS rc, {checks('l', 'field')} AS lf FROM x2),
x AS (SELECT *, op IS NOT NULL AND en IS NOT NULL AS paired, op IS NOT NULL AND en IS NOT NULL AND coalesce(lc = rc, false) AS concrete,
  CASE WHEN own THEN 'transferred ownership' WHEN inv THEN 'repaired invariant' WHEN imp THEN 'implementation choice' WHEN kind = 'completed-work-echo' THEN 'completed outcome' ELSE 'intended outcome' END AS category,
  own OR inv OR imp OR kind = 'completed-work-echo' AS backed, coalesce(CASE src WHEN 'acceptance_criteria' THEN 'acceptance criteria' ELSE src END, 'whole-record semantics') AS source_field FROM x3)"""


_X = _explain_sql()
_ANCHOR = """category AS anchor_category, coalesce(op, 'compare') AS anchor_operation, coalesce(en, 'acceptance condition') AS anchor_entity, source_field AS anchor_source_field,
  CASE WHEN concrete THEN 'concrete-check' WHEN paired THEN 'category-check' ELSE 'generic' END AS anchor_specificity,
  CASE WHEN concrete THEN lc WHEN paired THEN 'entity-category' ELSE 'unspecified' END AS anchor_check,
  CASE WHEN concrete THEN lf WHEN paired THEN source_field ELSE 'whole-record semantics' END AS anchor_check_field,
  CASE WHEN concrete AND backed THEN 'high' WHEN paired THEN 'medium' ELSE 'low' END AS anchor_confidence, NOT paired AS anchor_fallback"""


@query("exp4_anchors", f"{_X} SELECT kind, issue_id, related_issue_id, {_ANCHOR} FROM x")
def _(s, d):
    rows = _explained(s, d)
    return rows.select("kind", "issue_id", "related_issue_id", *[c for c in rows.columns if c.startswith("anchor_")])


_SAID = """CASE WHEN fam THEN 'direct parent/child scope can explain semantic similarity' WHEN structural_context = 'none recorded' THEN 'no structural relationship is recorded' END,
  CASE WHEN l_acceptance_criteria_text <> '' AND r_acceptance_criteria_text <> '' AND acceptance_criteria_score < 0.15 THEN 'acceptance criteria have little lexical alignment' END,
  CASE WHEN len(ev) = 0 THEN 'no canonical field has meaningful lexical overlap' END"""


@query("exp3_counterevidence", f"{_X} SELECT kind, issue_id, related_issue_id, concat_ws('; ', {_SAID}) AS counterevidence FROM x")
def _(s, d):
    return _explained(s, d).select("kind", "issue_id", "related_issue_id", F.array_join("counterevidence", "; ").alias("counterevidence"))


@query(
    "exp1_explanations",
    f"""{_X}, t AS (SELECT *, {_ANCHOR} FROM x) SELECT kind, issue_id, related_issue_id,
  printf('Similarity %s; closest fields: %s; lifecycle: %s to %s; structure: %s.', round(similarity::decimal(18, 6), 2)::varchar, CASE WHEN len(ev) = 0 THEN 'whole-record semantics' ELSE array_to_string(list_transform(ev[:2], lambda e: printf('%s (%s)', e.f, round(e.s::decimal(18, 6), 2)::varchar)), ' and ') END, l_status, r_status, structural_context) AS why_surfaced,
  CASE WHEN concrete THEN printf('%s, %s check in %s: %s %s', anchor_category, anchor_check, anchor_check_field, anchor_operation, anchor_entity) WHEN paired THEN 'shared category only: ' || anchor_operation || ' ' || anchor_entity ELSE 'no contract was found; read the acceptance conditions' END
  || '; ' || CASE WHEN kind = 'completed-work-echo' THEN 'see whether closed ' || related_issue_id || ' changes the remaining scope of ' || issue_id ELSE 'compare the acceptance conditions of ' || issue_id || ' and ' || related_issue_id END || '.'
  || CASE WHEN structural_context <> 'none recorded' THEN ' Already recorded: ' || structural_context || '.' ELSE '' END AS what_to_verify FROM t""",
)
def _(s, d):
    return _explained(s, d).select("kind", "issue_id", "related_issue_id", "why_surfaced", "what_to_verify")


@query(
    "agg11_anchor_metrics",
    f"""{_X}, t AS (SELECT {_ANCHOR} FROM x) SELECT count(*) AS total, count(*) FILTER (anchor_confidence = 'high') AS confidence_high, count(*) FILTER (anchor_confidence = 'medium') AS confidence_medium, count(*) FILTER (anchor_confidence = 'low') AS confidence_low,
  count(*) FILTER (anchor_specificity = 'concrete-check') AS specificity_concrete_check, count(*) FILTER (anchor_specificity = 'category-check') AS specificity_category_check, count(*) FILTER (anchor_specificity = 'generic') AS specificity_generic,
  count(*) FILTER (NOT anchor_fallback) AS actionable_proxy_count, coalesce(round(count(*) FILTER (NOT anchor_fallback) / nullif(count(*), 0), 4), 0.0)::double AS actionable_proxy_rate,
  count(*) FILTER (anchor_fallback) AS generic_fallback_count, coalesce(round(count(*) FILTER (anchor_fallback) / nullif(count(*), 0), 4), 0.0)::double AS generic_fallback_rate FROM t""",
)
def _(s, d):
    return anchors.anchor_metrics(_explained(s, d))


@query("obj1_objectives", QUALIFIED + " SELECT kind, lane, CASE WHEN lane = 'dependency' THEN 'structure' WHEN kind = 'completed-work-echo' THEN 'echo' ELSE 'overlap' END AS objective, count(*) AS candidates FROM qualified GROUP BY ALL")
def _(s, d):
    rows = Inputs(s, d).qualified()
    return rows.groupBy("kind", "lane", explain.objective(F.col("lane"), F.col("kind")).alias("objective")).agg(F.count("*").alias("candidates"))


_RANKED = "1 + (SELECT count(*) FROM {pool} p WHERE p.id NOT IN (q.{a}, q.{b}) AND (round(list_dot_product(p.v, a.v) - list_dot_product(a.v, b.v), 12) > 0 OR (round(list_dot_product(p.v, a.v) - list_dot_product(a.v, b.v), 12) = 0 AND p.id < q.{b})))"


@query(
    "prv1_provenance",
    f"""{QUALIFIED}, z AS (SELECT q.kind, q.issue_id, q.related_issue_id, round(list_dot_product(a.v, b.v), 6) AS pair_score,
  CASE WHEN q.kind = 'completed-work-echo' THEN {_RANKED.format(pool='cvec', a='issue_id', b='related_issue_id')} ELSE {_RANKED.format(pool='avec', a='issue_id', b='related_issue_id')} END AS issue_to_related,
  evidence_type AS relationship_type, lane = 'dependency' AS by_relation FROM qualified q JOIN vec a ON a.id = q.issue_id JOIN vec b ON b.id = q.related_issue_id),
w AS (SELECT q.kind, q.issue_id, q.related_issue_id, {_RANKED.format(pool='avec', a='related_issue_id', b='issue_id')} AS related_to_issue FROM qualified q JOIN vec a ON a.id = q.related_issue_id JOIN vec b ON b.id = q.issue_id)
SELECT * FROM z JOIN w USING (kind, issue_id, related_issue_id)""",
)
def _(s, d):
    """Where each side of a candidate stands in the other's ranking, and its typed relation."""
    i = Inputs(s, d)
    rows = stage(i.qualified().select("kind", "lane", "issue_id", "related_issue_id", "evidence_type"), "candidates")
    active, closed = V.pack(i.active_vectors), V.pack(i.closed_vectors)
    kinds = {k: rows.filter(F.col("kind") == k) for k in ("possible-overlap", "completed-work-echo")}
    out = None
    for kind, own in kinds.items():
        other = closed if kind == "completed-work-echo" else active
        pairs = own.select(F.col("issue_id").alias("query_id"), F.col("related_issue_id").alias("target_id"))
        pairs = stage(V.pair_scores(pairs, active, other), "pair-scores")
        ahead = V.pair_ranks(pairs, active, other)
        back = V.pair_ranks(pairs.select(F.col("target_id").alias("query_id"), F.col("query_id").alias("target_id"), "score"), other, active)
        ahead = ahead.select(F.col("query_id").alias("issue_id"), F.col("target_id").alias("related_issue_id"), F.round("score", 6).alias("pair_score"), F.col("rank").alias("issue_to_related"))
        back = back.select(F.col("query_id").alias("related_issue_id"), F.col("target_id").alias("issue_id"), F.col("rank").alias("related_to_issue"))
        made = own.join(ahead, ["issue_id", "related_issue_id"]).join(back, ["issue_id", "related_issue_id"])
        out = made if out is None else out.unionByName(made)
    return out.select("kind", "issue_id", "related_issue_id", "pair_score", "issue_to_related", "related_to_issue", F.col("evidence_type").alias("relationship_type"), (F.col("lane") == "dependency").alias("by_relation"))


# --- selection -------------------------------------------------------------------


@query("sel7_cap_replacements")
def _(s, d):
    """What stricter thresholds bring in through caps, compared with the loose queue."""
    i = Inputs(s, d)
    loose, strict = stage(_decisions(s, d, TIGHT, i)[1], "loose"), stage(_decisions(s, d, _STRICT, i)[1], "strict")
    rows = selection.replacements(loose, strict, TIGHT)
    step = lambda c: F.concat_ws(" ", c["event"], c["candidate_id"], c["resource"])
    return _lines(rows.withColumn("causal_chain", F.transform("causal_chain", step)), "displaced", "causal_chain")


_STRICT = type(TIGHT)(echo_threshold=0.33, overlap_threshold=0.38, max_total=60, max_per_issue=2, lane_reservations=TIGHT.lane_reservations)


@query(
    "sel6_degradation",
    f"WITH {oracles._qualified(objectives=('echo', 'overlap'))} SELECT kind, lane, count(*) AS candidates, 'dependency' AS lost_lane, 'discovery' AS lost_stage FROM qualified GROUP BY ALL",
)
def _(s, d):
    """A run whose dependency accounts are one relation short goes on with the semantic lanes."""
    i = Inputs(s, d)

    def run(policy):
        if policy.wants("structure"):
            funnel = relations.dependency_funnel(_funnel(s, d)).withColumn("eligible", F.col("eligible") - 1)
            selection.check_accounts(selection.dependency_accounts(funnel, _decisions(s, d, policy)[1]))
        return i.qualified(policy)

    rows, receipt = selection.with_degradation(run, POLICY)
    counts = rows.groupBy("kind", "lane").agg(F.count("*").alias("candidates"))
    return counts.withColumns({"lost_lane": F.lit(receipt["degraded_lanes"][0]), "lost_stage": F.lit(receipt["stage"])})


@query("flt5_gated_lanes", f"WITH {oracles._qualified(objectives=('echo',))} SELECT kind, lane, count(*) AS candidates FROM qualified GROUP BY ALL")
def _(s, d):
    policy = type(POLICY)(echo_threshold=0.35, overlap_threshold=0.40, objectives=frozenset({"echo"}))
    return Inputs(s, d).qualified(policy).groupBy("kind", "lane").agg(F.count("*").alias("candidates"))


@query("win8_rank_buckets", QUALIFIED + f" SELECT CASE WHEN k <= 20 THEN '1-20' WHEN k <= 50 THEN '21-50' WHEN k <= 200 THEN '51-200' END AS bucket, count(*) AS candidates FROM (SELECT row_number() OVER (ORDER BY {oracles._REPORT}) AS k FROM qualified) WHERE k <= 200 GROUP BY 1")
def _(s, d):
    from quillon.operators import qualify

    ranked = Inputs(s, d).qualified().withColumn("k", F.row_number().over(Window.orderBy(*qualify.report_key()))).filter("k <= 200")
    return ranked.groupBy(evaluate.rank_bucket(F.col("k"), (20, 50, 200)).alias("bucket")).agg(F.count("*").alias("candidates"))


_DRAWN = """, first250 AS (SELECT kind || '|' || issue_id || '|' || related_issue_id AS candidate_id, issue_id, related_issue_id, lane, k AS source_rank,
    CASE WHEN k <= 20 THEN '1-20' WHEN k <= 50 THEN '21-50' WHEN k <= 100 THEN '51-100' ELSE '101-250' END AS rank_bucket
  FROM (SELECT *, row_number() OVER (ORDER BY """ + oracles._REPORT + """)::int AS k FROM qualified) WHERE k <= 250),
drawn AS (SELECT *, row_number() OVER (PARTITION BY lane, rank_bucket ORDER BY sha256('ranked-evaluation-v1' || chr(0) || 'stratum' || chr(0) || candidate_id)) AS place FROM first250)
SELECT 'review-' || lpad((row_number() OVER (ORDER BY sha256('ranked-evaluation-v1' || chr(0) || 'blind-review-order' || chr(0) || candidate_id)))::varchar, 3, '0') AS review_id,
  candidate_id, lane, source_rank, rank_bucket FROM drawn WHERE place <= 10"""


@query("evl1_ranked_review", QUALIFIED + _DRAWN)
def _(s, d):
    """The blinded sample of the first 250 candidates of a report."""
    from quillon.operators import qualify
    from quillon.plans import ranked_review

    order = F.row_number().over(Window.orderBy(*qualify.report_key()))
    first = Inputs(s, d).qualified().orderBy(*qualify.report_key()).limit(250).withColumn("rank", order)
    rows = first.select("rank", "kind", "issue_id", "related_issue_id", "lane", F.lit(None).cast("string").alias("candidate_id"), "similarity")
    bounds = evaluate.parse_bounds(ranked_review.BOUNDS, 250)
    drawn = ranked_review.draw(ranked_review.fixed_pool(rows, 250, bounds), ranked_review.SEED, bounds, 10)
    return drawn.select("review_id", "candidate_id", "lane", "source_rank", "rank_bucket")


@query("sup4_lane_fallback", QUALIFIED + " SELECT kind, CASE WHEN kind = 'completed-work-echo' THEN 'echo' WHEN kind = 'possible-overlap' THEN 'overlap' ELSE 'dependency' END AS fallback, count(*) AS candidates FROM qualified GROUP BY ALL")
def _(s, d):
    kind = F.col("kind")
    lane = F.when(kind == "completed-work-echo", "echo").when(kind == "possible-overlap", "overlap").otherwise("dependency")
    return Inputs(s, d).qualified().groupBy("kind", lane.alias("fallback")).agg(F.count("*").alias("candidates"))


@query("srt3_evidence_order", QUALIFIED + " SELECT issue_id, related_issue_id, kind, row_number() OVER (ORDER BY similarity DESC, issue_id, related_issue_id, kind) AS position FROM qualified")
def _(s, d):
    order = Window.orderBy(F.desc("similarity"), "issue_id", "related_issue_id", "kind")
    return Inputs(s, d).qualified().select("issue_id", "related_issue_id", "kind", F.row_number().over(order).cast("long").alias("position"))


# --- surfaces, records, relations --------------------------------------------------


@query("srt7_pointer_order", f"WITH {oracles._PTR} SELECT issue_id, path, source, source_field, edit_intent, context_kind, path_presence, revision, row_number() OVER (PARTITION BY issue_id ORDER BY path, source, coalesce(source_field, ''), edit_intent, context_kind, path_presence, coalesce(revision, '')) AS position FROM pointers")
def _(s, d):
    none = lambda c: F.coalesce(c, F.lit(""))
    order = Window.partitionBy("issue_id").orderBy("path", "source", none("source_field"), "edit_intent", "context_kind", "path_presence", none("revision"))
    rows = _pointers(s, d)
    return rows.select("issue_id", "path", "source", "source_field", "edit_intent", "context_kind", "path_presence", "revision", F.row_number().over(order).cast("long").alias("position"))


_BRANCHES = "SELECT '/w/' || n_nationkey AS path, CASE n_nationkey % 5 WHEN 0 THEN 'fix/doc-' || printf('%06d', n_nationkey) WHEN 1 THEN 'Doc-' || printf('%06d', n_nationkey) || '_try' WHEN 2 THEN 'xdoc-' || printf('%06d', n_nationkey) WHEN 3 THEN 'doc-' || printf('%06d', n_nationkey) || '-doc-' || printf('%06d', n_nationkey + 100) ELSE 'main' END AS branch FROM nation"


@query(
    "jon12_worktrees",
    BASE + f", w AS ({_BRANCHES}), fit AS (SELECT w.path, id FROM w JOIN active ON regexp_matches(lower(branch), '(^|[/_-])' || id || '($|[/_-])')) SELECT min(id) AS issue_id, path FROM fit GROUP BY path HAVING count(*) = 1",
)
def _(s, d):
    n = F.col("n_nationkey")
    own = lambda k: F.format_string("doc-%06d", k)
    branch = (
        F.when(n % 5 == 0, F.concat(F.lit("fix/"), own(n))).when(n % 5 == 1, F.concat(F.initcap(own(n)), F.lit("_try")))
        .when(n % 5 == 2, F.concat(F.lit("x"), own(n))).when(n % 5 == 3, F.concat_ws("-", own(n), own(n + 100))).otherwise("main")
    )
    trees = R.table(s, d, "nation").select(F.concat(F.lit("/w/"), n.cast("string")).alias("path"), branch.alias("branch"))
    issues = Inputs(s, d).active.select(F.col("id").alias("issue_id"))
    return surfaces.associate_worktrees(issues, trees, issues.limit(0).withColumn("path", F.lit("")))


@query("str12_code_fences", "SELECT item_id, CASE WHEN item_id % 3 = 1 THEN 'code-fence' ELSE 'prose' END AS context FROM benchmark")
def _(s, d):
    k = F.col("item_id") % 3
    text = F.concat(F.lit("a\n"), F.repeat(F.lit("```\nb\n"), k.cast("int")), F.lit("x/y.py"))
    return R.table(s, d, "benchmark").select("item_id", surfaces.in_code_fence(text, F.length(text) - 6).alias("context"))


@query("set1_channel_union", f"{BASE}, {oracles._VEC} SELECT left_id, right_id FROM ({oracles._upper('avec', 0.4)}) UNION SELECT left_id, right_id FROM ({oracles._upper('cvec', 0.4)})")
def _(s, d):
    i = Inputs(s, d)
    pairs = [V.pairs_above(v, None, 0.4).select("left_id", "right_id") for v in (i.active_vectors, i.closed_vectors)]
    return pairs[0].union(pairs[1]).distinct()


@query("sup3_candidate_ids", QUALIFIED + " SELECT count(*) AS candidates, count(DISTINCT kind || '|' || issue_id || '|' || related_issue_id) AS ids, count(*) FILTER (issue_id = related_issue_id) AS loops FROM qualified")
def _(s, d):
    name = F.concat_ws("|", "kind", "issue_id", "related_issue_id")
    return Inputs(s, d).qualified().agg(F.count("*").alias("candidates"), F.countDistinct(name).alias("ids"), F.count_if(F.col("issue_id") == F.col("related_issue_id")).alias("loops"))


@query("sup5_first_relations", EDGED + " SELECT source_id, target_id, CASE WHEN bool_or(relationship_type = 'parent-child') THEN 'parent-child' ELSE min(relationship_type) END AS relation, min(relationship_type) FILTER (relationship_type <> 'parent-child') AS other FROM edges GROUP BY ALL")
def _(s, d):
    parent = F.col("relationship_type") == "parent-child"
    first = F.when(F.bool_or(parent), "parent-child").otherwise(F.min("relationship_type"))
    return Inputs(s, d).edges.groupBy("source_id", "target_id").agg(first.alias("relation"), F.min(F.when(~parent, F.col("relationship_type"))).alias("other"))


@query("sup17_type_counts", EDGED + " SELECT string_agg(relationship_type || '=' || n, ', ' ORDER BY relationship_type) AS types FROM (SELECT relationship_type, count(*) AS n FROM typed GROUP BY 1)")
def _(s, d):
    counts = Inputs(s, d).typed.groupBy("relationship_type").agg(F.count("*").alias("n"))
    parts = F.array_sort(F.collect_list(F.concat_ws("=", "relationship_type", "n")))
    return counts.agg(F.array_join(parts, ", ").alias("types"))


@query("sup19_safe_scores", "SELECT event_id, CASE WHEN event_id % 7 = 0 OR event_id % 11 = 0 OR value IS NULL THEN -1.0::double ELSE value END AS score FROM events")
def _(s, d):
    n = F.col("event_id")
    value = F.when(n % 7 == 0, F.lit(float("nan"))).when(n % 11 == 0, F.lit(None).cast("double")).otherwise(F.col("value"))
    finite = ~F.isnan(value) & (F.abs(value) != float("inf"))
    return R.table(s, d, "events").select("event_id", F.when(F.coalesce(finite, F.lit(False)), value).otherwise(-1.0).alias("score"))


@query("sup26_dimensions", "SELECT count(*) AS vectors, count(DISTINCT len(embedding)) = 1 AS fixed, max(len(embedding))::int AS dimension FROM embeddings")
def _(s, d):
    size = F.size("embedding")
    return R.table(s, d, "embeddings").agg(F.count("*").alias("vectors"), (F.countDistinct(size) == 1).alias("fixed"), F.max(size).alias("dimension"))


@query("sup30_knn", f"WITH {oracles._REC}, {oracles._VEC} SELECT query_id, candidate_id, rank FROM (SELECT a.id AS query_id, b.id AS candidate_id, row_number() OVER (PARTITION BY a.id ORDER BY list_dot_product(a.v, b.v) DESC, b.id) AS rank FROM cvec a JOIN vec b ON a.id <> b.id) WHERE rank <= 10")
def _(s, d):
    i = Inputs(s, d)
    return V.top_ranks(i.closed_vectors, i.vectors, 10).select("query_id", "candidate_id", F.col("rank").cast("long").alias("rank"))


# --- readers ---------------------------------------------------------------------


def _raw_records(s: SparkSession, d: str) -> DataFrame:
    """Records as a tracker prints them: JSON with other names, P-priorities, label objects."""
    i, n = Inputs(s, d), F.col("n")
    label = F.when(n % 2 == 0, F.to_json(F.transform("labels", lambda x: F.struct(x.alias("name"))))).otherwise(F.to_json("labels"))
    links = i.typed.groupBy(F.col("source_id").alias("id")).agg(F.to_json(F.array_sort(F.collect_list(F.struct(F.col("source_id").alias("issue_id"), F.col("target_id").alias("depends_on_id"), F.col("relationship_type").alias("type"))))).alias("links"))
    flat = F.to_json(F.struct("id", F.concat(F.lit("T "), "id").alias("title"), F.col("acceptance_criteria").alias("acceptance"), "status", F.concat(F.lit("P"), F.col("priority")).alias("priority"), F.col("parent_id").alias("parent"), F.col("updated_at").alias("updatedAt"), "ephemeral"))
    more = F.concat(F.lit(',"labels":'), label, F.lit(',"dependencies":'), F.coalesce("links", F.lit("[]")), F.lit("}"))
    return i.records.join(links, "id", "left").select(flat.alias("flat"), more.alias("more")).select(F.concat(F.substring("flat", F.lit(1), F.length("flat") - 1), "more").alias("raw"))


@query(
    "src2_tracker_records",
    EDGED + ", l AS (SELECT source_id AS id, string_agg(DISTINCT target_id || ':' || relationship_type, ',' ORDER BY target_id || ':' || relationship_type) AS links FROM typed GROUP BY 1) SELECT id, 'T ' || id AS title, acceptance_criteria, status, priority, parent_id, updated_at, ephemeral, array_to_string(list_sort(list_distinct(list_transform(labels, lambda x: trim(x)))), ',') AS labels, coalesce(links, '') AS links FROM records LEFT JOIN l USING (id)",
)
def _(s, d):
    rows = trackers.parse_records(_raw_records(s, d))
    links = F.array_join(F.transform("links", lambda p: F.concat_ws(":", p["target_id"], p["relationship_type"])), ",")
    return rows.select("id", "title", "acceptance_criteria", "status", "priority", "parent_id", "updated_at", "ephemeral", F.array_join("labels", ",").alias("labels"), links.alias("links"))


@query("src15_label_records", "SELECT 'eng-gh-' || doc_id AS id, CASE WHEN doc_id % 3 = 0 THEN 'bug' WHEN doc_id % 3 = 1 THEN 'feature' ELSE 'task' END AS issue_type, CASE WHEN doc_id % 3 = 0 THEN 0 WHEN doc_id % 3 = 1 THEN 3 ELSE 2 END AS priority, CASE WHEN doc_id % 2 = 0 THEN 'closed' ELSE 'open' END AS status, length(substr(text, 1, 100)) AS chars FROM documents")
def _(s, d):
    n = F.col("doc_id")
    labels = F.when(n % 3 == 0, F.array(F.lit("Regression"), F.lit("P0"))).when(n % 3 == 1, F.array(F.lit("enhancement"), F.lit("low priority"))).otherwise(F.array(F.lit("chore")))
    issues = R.table(s, d, "documents").select(n.alias("number"), F.lit("t").alias("title"), F.col("text").alias("body"), F.when(n % 2 == 0, "CLOSED").otherwise("OPEN").alias("state"), labels.alias("labels"))
    rows = host_pages.label_records(issues, "x/Eng", 100)
    return rows.select("id", "issue_type", "priority", "status", F.length("description").cast("long").alias("chars"))


def queries() -> dict[str, Query]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)
