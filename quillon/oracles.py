"""The same results in SQL for another engine, for comparison."""

from __future__ import annotations

from quillon.functions.text import FUNCTION_WORDS, GENERIC_TOKENS, WORKFLOW_TERMS
from quillon.operators.freshness import EVIDENCE_ORDER
from quillon.operators.surfaces import CODE_EXTENSIONS, DIRECTORY_ROOTS, IGNORED_PARTS

STOPS = "about after also been before being between from have into only should that their then this through using when where with".split()


def _list(words) -> str:
    return "[" + ", ".join(f"'{w}'" for w in words) + "]"


_ID = "printf('doc-%06d', {})"
_REC = f"""records AS (
  SELECT doc_id AS n, {_ID.format('doc_id')} AS id, split_part(text, chr(10), 1) AS title,
    CASE WHEN contains(text, chr(10)) THEN substr(text, strpos(text, chr(10)) + 1) ELSE '' END AS description,
    ['closed', 'open', 'in_progress', 'blocked'][doc_id % 4 + 1] AS status,
    CASE WHEN doc_id % 31 = 0 THEN 'epic' ELSE 'task' END AS issue_type, (doc_id % 5)::int AS priority, [lang, source] AS labels,
    CASE WHEN first_id <> doc_id THEN {_ID.format('first_id')} END AS parent_id,
    split_part(text, chr(10), 2) AS acceptance_criteria, '' AS design, '' AS notes,
    strftime(TIMESTAMP '2024-01-01' + to_minutes(doc_id), '%Y-%m-%dT%H:%M:%SZ') AS updated_at, doc_id % 29 = 0 AS ephemeral
  FROM documents LEFT JOIN (SELECT source, min(doc_id) AS first_id FROM documents GROUP BY source) USING (source)),
active AS (SELECT * FROM records WHERE status IN ('open', 'in_progress', 'blocked', 'deferred') AND issue_type <> 'epic' AND NOT ephemeral),
closed AS (SELECT * FROM records WHERE status = 'closed')"""
_RULES = [(5, 1, "blocks", 0), (11, 2, "discovered-from", 0), (13, 3, "parent-child", 0), (7, 1, "blocks", 1), (35, 1, "related", 0), (17, 4, "relates-to", 1)]
_TYPED = "typed AS (" + " UNION ALL ".join(
    f"SELECT {_ID.format(f'doc_id - {back if turned else 0}')} AS source_id, {_ID.format(f'doc_id - {0 if turned else back}')} AS target_id, "
    f"'{kind}' AS relationship_type FROM documents WHERE doc_id % {every} = 0 AND doc_id >= {back}"
    for every, back, kind, turned in _RULES
) + ")"
_EDG = f"""{_TYPED},
legacy AS (SELECT {_ID.format('doc_id')} AS source_id, CASE WHEN doc_id % 19 = 0 THEN {_ID.format('doc_id - 4')} ELSE {_ID.format('doc_id - 1')} END AS target_id
  FROM documents WHERE doc_id >= 4 AND (doc_id % 19 = 0 OR doc_id % 5 = 0)),
edges AS (SELECT DISTINCT * FROM typed UNION ALL
  SELECT DISTINCT source_id, target_id, 'depends-on' FROM legacy l
  WHERE NOT EXISTS (SELECT 1 FROM typed t WHERE t.source_id = l.source_id AND t.target_id = l.target_id))"""
_VEC = f"""vec0 AS (SELECT {_ID.format('vec_id')} AS id, embedding::double[] AS e FROM embeddings WHERE vec_id IN (SELECT doc_id FROM documents)),
vec AS (SELECT id, list_transform(e, lambda x: x / sqrt(list_sum(list_transform(e, lambda y: y * y)))) AS v FROM vec0),
avec AS (SELECT * FROM vec WHERE id IN (SELECT id FROM active)),
cvec AS (SELECT * FROM vec WHERE id IN (SELECT id FROM closed))"""
_DIRECT = """direct AS (SELECT source_id, target_id, bool_or(relationship_type = 'parent-child') AS parent_child,
  min(relationship_type) FILTER (relationship_type <> 'parent-child') AS other FROM edges GROUP BY ALL)"""
_RANK = "ranked{k} AS (SELECT a.id AS query_id, b.id AS candidate_id, list_dot_product(a.v, b.v) AS score, row_number() OVER (PARTITION BY a.id ORDER BY list_dot_product(a.v, b.v) DESC, b.id) AS rank FROM {a} a JOIN {b} b ON a.id <> b.id)"


def _upper(a: str, threshold: float) -> str:
    return f"SELECT a.id AS left_id, b.id AS right_id, list_dot_product(a.v, b.v) AS score FROM {a} a JOIN {a} b ON a.id < b.id WHERE list_dot_product(a.v, b.v) >= {threshold}"


def _structure(pairs: str) -> str:
    """CTE ``structured`` of a relation with left_id and right_id."""
    return f"""structured AS (
  SELECT p.*, CASE WHEN l.parent_id = p.right_id OR r.parent_id = p.left_id THEN 'parent/child'
      WHEN f.parent_child THEN 'parent/child'
      WHEN f.other IS NOT NULL THEN p.left_id || ' depends on ' || p.right_id || ' (' || f.other || ')'
      WHEN b.parent_child THEN 'parent/child'
      WHEN b.other IS NOT NULL THEN p.right_id || ' depends on ' || p.left_id || ' (' || b.other || ')'
      WHEN l.parent_id = r.parent_id THEN 'same parent ' || l.parent_id ELSE 'none recorded' END AS structural_context,
    coalesce(f.other, b.other) AS evidence_type,
    CASE WHEN f.other IS NOT NULL THEN p.left_id WHEN b.other IS NOT NULL THEN p.right_id END AS evidence_source,
    CASE WHEN f.other IS NOT NULL THEN p.right_id WHEN b.other IS NOT NULL THEN p.left_id END AS evidence_target
  FROM {pairs} p LEFT JOIN records l ON l.id = p.left_id LEFT JOIN records r ON r.id = p.right_id
  LEFT JOIN direct f ON f.source_id = p.left_id AND f.target_id = p.right_id
  LEFT JOIN direct b ON b.source_id = p.right_id AND b.target_id = p.left_id)"""


_CAMEL = r"lower(regexp_replace({}, '([a-z0-9])([A-Z])', '\1 \2', 'g'))"
_LONG = "regexp_extract_all(" + _CAMEL + ", '[a-z0-9][a-z0-9_-]{{2,}}')"


def _tokens(field: str) -> str:
    return f"list_filter({_LONG.format(field)}, lambda t: NOT list_contains({_list(GENERIC_TOKENS)}, t))"


def _phrases(tokens: str) -> str:
    return f"list_distinct(list_transform(range(1, len({tokens})), lambda i: {tokens}[i] || ' ' || {tokens}[i + 1]))"


def _evidence(pairs: str, corpus: str) -> str:
    """CTEs up to ``evidence (left_id, right_id, reason)``."""
    return f"""tok AS (SELECT id, {_tokens('title')} AS t, {_tokens('description')} AS d, {_tokens('acceptance_criteria')} AS a,
    trim(description) || trim(acceptance_criteria) <> '' AS has_body,
    list_filter(list_distinct({_LONG.format('title')}), lambda t: NOT list_contains({_list(FUNCTION_WORDS)}, t)) AS sparse FROM {corpus}),
tdf AS (SELECT term, count(*) AS df FROM (SELECT unnest(list_distinct(t || d || a)) AS term FROM tok) GROUP BY term),
pdf AS (SELECT term, count(*) AS df FROM (SELECT unnest(list_distinct({_phrases('t')} || {_phrases('d')} || {_phrases('a')})) AS term FROM tok) GROUP BY term),
lim AS (SELECT count(*) AS records, greatest(2, floor(count(*) * 0.1))::bigint AS rare, greatest(2, floor(count(*) * 0.03))::bigint AS align FROM tok),
ev0 AS (SELECT DISTINCT left_id, right_id FROM {pairs}),
ev AS (SELECT left_id, right_id, list_intersect(l.t, r.t) AS st,
    list_intersect(l.t, r.t || r.d || r.a) || list_intersect(r.t, l.t || l.d || l.a) AS sa,
    list_intersect({_phrases('l.d')}, {_phrases('r.d')}) || list_intersect({_phrases('l.a')}, {_phrases('r.a')}) AS sp,
    (NOT l.has_body OR NOT r.has_body) AND (len(list_intersect(l.sparse, r.sparse)) >= 2 OR list_has_any(list_intersect(l.sparse, r.sparse), {_list(WORKFLOW_TERMS)})) AS sf
  FROM ev0 JOIN tok l ON l.id = left_id JOIN tok r ON r.id = right_id),
mt AS (SELECT left_id, right_id, min(df) AS m FROM (SELECT left_id, right_id, unnest(st) AS term FROM ev) JOIN tdf USING (term) GROUP BY ALL),
ma AS (SELECT left_id, right_id, min(df) AS m FROM (SELECT left_id, right_id, unnest(sa) AS term FROM ev) JOIN tdf USING (term) GROUP BY ALL),
mp AS (SELECT left_id, right_id, min(df) AS m FROM (SELECT left_id, right_id, unnest(sp) AS term FROM ev) JOIN pdf USING (term) GROUP BY ALL),
evidence AS (SELECT ev.left_id, ev.right_id, CASE WHEN mt.m <= rare THEN 'discriminative-title-token' WHEN ma.m <= align THEN 'discriminative-title-alignment'
    WHEN sf THEN 'sparse-title-alignment' WHEN mp.m <= rare THEN 'discriminative-field-phrase' END AS reason
  FROM ev CROSS JOIN lim LEFT JOIN mt USING (left_id, right_id) LEFT JOIN ma USING (left_id, right_id) LEFT JOIN mp USING (left_id, right_id))"""


def _qualified(echo: float = 0.35, overlap: float = 0.40, margin: float = 0.08, objectives: tuple[str, ...] | None = None, scope: str = "true", alternatives: int = 3) -> str:
    """All CTEs up to ``qualified``. ``scope`` is a predicate on an alias ``e``."""
    legacy = objectives is None
    wants = lambda o: str(legacy or o in objectives).lower()
    live = f"(SELECT e.id FROM active e WHERE {scope})"
    parts = []
    for kind, threshold, own in (("possible-overlap", overlap, "overlap"), ("completed-work-echo", echo, "echo")):
        near = f"CASE WHEN score >= {threshold} THEN 'semantic-threshold' WHEN {str(legacy).lower()} AND starts_with(structural_context, 'same parent ') THEN 'shared-parent-threshold-exception' WHEN {wants('structure')} AND evidence_type IS NOT NULL THEN 'dependency-threshold-exception' WHEN {wants(own)} AND structural_context <> 'parent/child' AND left_rank <= 5 AND right_rank <= 5 AND reason IS NOT NULL THEN 'reciprocal-neighbor-threshold-exception' END"
        barred = f"AND structural_context <> 'parent/child'" if kind == "possible-overlap" and not legacy and own in objectives else ""
        parts.append(
            f"SELECT *, {near} AS admission_reason FROM facts WHERE kind = '{kind}' AND score >= {threshold - margin} AND ({wants(own)} OR ({wants('structure')} AND evidence_type IS NOT NULL)) {barred}"
        )
    return f"""{_REC}, {_EDG}, {_VEC}, {_DIRECT}, {_RANK.format(k='_o', a='avec', b='avec')}, {_RANK.format(k='_ac', a='avec', b='cvec')}, {_RANK.format(k='_ca', a='cvec', b='avec')},
pool AS (SELECT 'possible-overlap' AS kind, left_id, right_id, score FROM ({_upper('avec', overlap - margin)}) WHERE left_id IN {live} OR right_id IN {live}
  UNION ALL SELECT 'completed-work-echo', a.id, b.id, list_dot_product(a.v, b.v) FROM avec a JOIN cvec b ON a.id <> b.id WHERE list_dot_product(a.v, b.v) >= {echo - margin} AND a.id IN {live}),
{_structure('pool')}, {_evidence('pool', '(SELECT * FROM active UNION SELECT * FROM closed)')},
facts AS (SELECT s.*, evidence.reason, coalesce(o1.rank, c1.rank) AS left_rank, coalesce(o2.rank, c2.rank) AS right_rank FROM structured s LEFT JOIN evidence USING (left_id, right_id)
  LEFT JOIN ranked_o o1 ON kind = 'possible-overlap' AND o1.query_id = left_id AND o1.candidate_id = right_id
  LEFT JOIN ranked_o o2 ON kind = 'possible-overlap' AND o2.query_id = right_id AND o2.candidate_id = left_id
  LEFT JOIN ranked_ac c1 ON kind = 'completed-work-echo' AND c1.query_id = left_id AND c1.candidate_id = right_id
  LEFT JOIN ranked_ca c2 ON kind = 'completed-work-echo' AND c2.query_id = right_id AND c2.candidate_id = left_id),
decided AS (SELECT * FROM ({' UNION ALL '.join(parts)}) WHERE admission_reason IS NOT NULL),
laned AS (SELECT kind, CASE WHEN evidence_type IS NOT NULL AND {wants('structure')} THEN 'dependency' WHEN kind = 'completed-work-echo' THEN 'echo' ELSE 'overlap' END AS lane,
  left_id AS issue_id, right_id AS related_issue_id, round(score, 6) AS similarity, structural_context, evidence_source, evidence_target, evidence_type, admission_reason,
  CASE WHEN admission_reason = 'reciprocal-neighbor-threshold-exception' THEN 'discriminative-local-evidence' ELSE 'semantic' END AS signal_quality,
  CASE WHEN admission_reason = 'reciprocal-neighbor-threshold-exception' THEN reason END AS reciprocal_evidence,
  CASE WHEN evidence_type IS NOT NULL THEN 'typed-dependency' WHEN starts_with(structural_context, 'same parent ') THEN 'shared-parent' ELSE 'none' END AS structural_corroboration FROM decided),
numbered AS (SELECT *, row_number() OVER (PARTITION BY kind, issue_id, lane = 'dependency' ORDER BY {_KEY}) AS k FROM laned),
qualified AS (SELECT * EXCLUDE (k) FROM numbered WHERE kind = 'possible-overlap' OR lane = 'dependency' OR k <= {alternatives})"""


_KEY = "CASE lane WHEN 'dependency' THEN 0 WHEN 'echo' THEN 1 ELSE 2 END, (admission_reason <> 'semantic-threshold')::int, (signal_quality = 'vocabulary-only')::int, similarity DESC, kind, issue_id, related_issue_id"
_REPORT = "(admission_reason <> 'semantic-threshold')::int, similarity DESC, kind, issue_id, related_issue_id"


def _pick(*names: str) -> str:
    return f"{_list(names)}[l_linenumber % {len(names)} + 1]"


_PTR = f"""pointers AS (SELECT DISTINCT l_orderkey AS issue_id, 'src/m' || l_partkey // 10 || '/f' || l_partkey || '.py' AS path,
    CASE WHEN l_orderkey % 5 = 0 THEN 'active-worktree-diff' ELSE 'explicit-reference' END AS source,
    CASE WHEN l_orderkey % 5 = 0 THEN 'observed-edit' ELSE {_pick('likely-edit', 'reference-only', 'unknown')} END AS edit_intent,
    CASE WHEN l_orderkey % 5 = 0 THEN 'observed-worktree' ELSE {_pick('prose', 'code-fence')} END AS context_kind,
    {_pick('existing', 'missing', 'unavailable', 'existing')} AS path_presence,
    CASE WHEN l_orderkey % 5 = 0 THEN 'r' || l_orderkey % 3 END AS revision, {_pick('title', 'description')} AS source_field,
    'src/m' || l_partkey // 10 AS module, CASE WHEN l_returnflag = 'A' THEN 'run_' || l_suppkey END AS symbol
  FROM lineitem JOIN orders ON o_orderkey = l_orderkey),
surf AS (SELECT issue_id, kind, surface, bool_or(source = 'active-worktree-diff') AS observed FROM (
    SELECT issue_id, source, 'path' AS kind, path AS surface FROM pointers UNION ALL SELECT issue_id, source, 'module', module FROM pointers
    UNION ALL SELECT issue_id, source, 'symbol', path || '::' || symbol FROM pointers WHERE symbol IS NOT NULL) GROUP BY ALL),
hub AS (SELECT kind, surface, count(*) AS issue_count FROM surf WHERE kind <> 'symbol' GROUP BY ALL HAVING count(*) > 5),
shared AS (SELECT a.issue_id, b.issue_id AS related_issue_id, kind, surface, a.observed OR b.observed AS observed
  FROM surf a JOIN surf b USING (kind, surface) WHERE a.issue_id < b.issue_id
    AND ((kind, surface) NOT IN (SELECT (kind, surface) FROM hub) OR (kind = 'path' AND (a.observed OR b.observed)))),
sp0 AS (SELECT issue_id, related_issue_id, list_sort(coalesce(list(DISTINCT surface) FILTER (kind = 'path'), []))[:8] AS p,
    list_sort(coalesce(list(DISTINCT surface) FILTER (kind = 'symbol'), []))[:8] AS symbols,
    list_transform(list_filter(list_sort(coalesce(list(DISTINCT {{s: surface, o: observed}}) FILTER (kind = 'module'), []))[:8], lambda x: x.o), lambda x: x.s) AS modules FROM shared GROUP BY ALL),
sp AS (SELECT issue_id, related_issue_id, list_sort(list_distinct(list_concat(p, list_transform(symbols, lambda x: regexp_extract(x, '^(.*)::', 1)))))[:8] AS paths, symbols, modules FROM sp0),
pairs AS (SELECT * FROM sp WHERE len(paths) + len(symbols) + len(modules) > 0),
facts AS (SELECT p.issue_id, p.related_issue_id, paths, symbols, modules, q.*EXCLUDE (issue_id), q.issue_id = p.issue_id AS is_left,
    list_contains(paths, path) OR list_contains(modules, module) OR coalesce(list_contains(symbols, path || '::' || symbol), false) AS hit
  FROM (SELECT *, issue_id AS one FROM pairs UNION ALL SELECT *, related_issue_id FROM pairs) p JOIN pointers q ON q.issue_id = p.one),
agg AS (SELECT issue_id, related_issue_id, any_value(paths) AS paths, any_value(symbols) AS symbols, any_value(modules) AS modules,
    coalesce(bool_or(source = 'active-worktree-diff') FILTER (hit AND is_left), false)::int + coalesce(bool_or(source = 'active-worktree-diff') FILTER (hit AND NOT is_left), false)::int AS sides,
    list_sort(list(DISTINCT source) FILTER (hit)) AS sources, list(DISTINCT edit_intent) FILTER (hit) AS intents, list(DISTINCT context_kind) FILTER (hit) AS contexts,
    list(DISTINCT path_presence) FILTER (hit) AS presence, list_sort(list(DISTINCT source_field) FILTER (hit)) AS fields, count(DISTINCT revision) AS revisions
  FROM facts GROUP BY issue_id, related_issue_id),
collisions AS (SELECT issue_id, related_issue_id, CASE WHEN len(paths) > 0 THEN 'exact-file' ELSE 'shared-module' END AS kind,
    array_to_string(paths, ',') AS shared_paths, array_to_string(symbols, ',') AS shared_symbols, array_to_string(modules, ',') AS shared_modules,
    ['explicit', 'corroborated', 'observed'][sides + 1] AS confidence, array_to_string(sources, ',') AS evidence_sources,
    CASE WHEN list_contains(intents, 'observed-edit') THEN 'observed-edit' WHEN list_has_all(intents, ['likely-edit', 'reference-only']) THEN 'mixed'
      WHEN list_contains(intents, 'likely-edit') THEN 'likely-edit' WHEN list_contains(intents, 'reference-only') THEN 'reference-only' ELSE 'unknown' END AS edit_intent,
    CASE WHEN list_contains(contexts, 'observed-worktree') THEN 'observed-worktree' WHEN contexts = ['code-fence'] THEN 'code-fence-only'
      WHEN list_has_all(contexts, ['code-fence', 'prose']) THEN 'mixed' ELSE 'prose' END AS context_kind,
    CASE WHEN presence = ['unavailable'] THEN 'unavailable' WHEN presence = ['existing'] THEN 'all-existing' WHEN presence = ['missing'] THEN 'all-missing' ELSE 'mixed' END AS path_presence,
    CASE revisions WHEN 0 THEN 'unavailable' WHEN 1 THEN 'same' ELSE 'different' END AS revision_relation, array_to_string(fields, ',') AS intent_source_fields FROM agg)"""

_HELD = """held AS (SELECT DISTINCT a.issue_id AS a, b.issue_id AS b FROM surf a JOIN surf b USING (kind, surface) WHERE a.issue_id < b.issue_id AND kind <> 'symbol'
  EXCEPT SELECT issue_id, related_issue_id FROM sp)"""
_PATHS = "['src/a%d.py', '`lib/x%d.TXT`', 'docs/p%d/', '/abs/%d.py', 'other/q%d/', 'src/../%d.py', 'node_modules/%d.js', '(src\\w%d.Go)', 'C:/x%d.py', './src/%d.py']"
_JUDGED = f"""q AS (SELECT {_ID.format('doc_id')} AS id, quality, lead(doc_id) OVER (ORDER BY doc_id) AS nxt FROM labels),
judged AS (SELECT a.id AS left_id, b.id AS right_id, a.quality + b.quality AS rating FROM q a JOIN q b ON b.id = {_ID.format('a.nxt')} WHERE a.id IN (SELECT id FROM vec) AND b.id IN (SELECT id FROM vec)),
js AS (SELECT j.*, list_dot_product(a.v, b.v) AS score FROM judged j JOIN vec a ON a.id = left_id JOIN vec b ON b.id = right_id)"""
_TFIDF = """tk AS (SELECT item_id AS id, unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) AS token FROM benchmark),
tf AS (SELECT id, token, count(*) AS tf FROM tk GROUP BY ALL), df AS (SELECT token, count(*) AS df FROM tf GROUP BY token),
w AS (SELECT id, token, tf * (ln(((SELECT count(DISTINCT id) FROM tf) + 1) / (df + 1)::double) + 1) AS w FROM tf JOIN df USING (token)),
weights AS (SELECT id, token, w / sqrt(sum(w * w) OVER (PARTITION BY id)) AS weight FROM w)"""
_SNAP = """now AS (SELECT * REPLACE (CASE WHEN n % 10 = 0 THEN 'resolved' ELSE status END AS status) FROM records WHERE n % 17 <> 0),
before AS (SELECT * FROM records WHERE n % 23 <> 0)"""


#: Case folding and NFKC of the letters that the tables have.
_FOLDED = "replace(lower({}), 'ß', 'ss')"
_PLAIN = "array_to_string(regexp_extract_all(" + _FOLDED + ", '[\\p{{L}}\\p{{N}}]+'), ' ')"


def _freshness() -> str:
    """CTEs up to ``assessed``: the pool with positions and what freshness says of it.

    A cue counts where it stands within 96 characters of the id; the rarer
    wordings are left to the tests, as no text of the tables holds an id.
    """
    cue = r"(after|before|block|builds? on|continu|depends? on|discovered from|follow-up|relat|supersed)"
    fields = ("title", "description", "acceptance_criteria", "design")
    named = " OR ".join(f"regexp_matches(substr({a}.{f}, 1, 4096), '(?is){cue}.{{0,96}}' || {b} || '|' || {b} || '.{{0,96}}{cue}')" for a, b in (("l", "p.related_issue_id"), ("r", "p.issue_id")) for f in fields)
    order = _list(EVIDENCE_ORDER)
    return f"""{_qualified()},
placed AS (SELECT *, (row_number() OVER (ORDER BY {_KEY}))::int AS position FROM qualified),
bonds AS (SELECT least(source_id, target_id) AS lo, greatest(source_id, target_id) AS hi, relationship_type AS t FROM edges WHERE relationship_type IN ('parent-child', 'blocks', 'depends-on', 'discovered-from')
  UNION SELECT least(id, parent_id), greatest(id, parent_id), 'parent-child' FROM records WHERE parent_id IS NOT NULL),
bound AS (SELECT lo, hi, list('direct-' || t) AS direct FROM bonds GROUP BY ALL),
used AS (SELECT DISTINCT issue_id, related_issue_id FROM placed JOIN edges e ON e.target_id IN (issue_id, related_issue_id) WHERE e.source_id NOT IN (issue_id, related_issue_id) AND e.source_id IN (SELECT id FROM active)),
seen AS (SELECT p.*, coalesce(bound.direct, []) AS direct, used.issue_id IS NOT NULL AS consumed, {named} AS cue,
    {_PLAIN.format('l.title')} <> '' AND {_PLAIN.format('l.title')} = {_PLAIN.format('r.title')} AS same,
    CASE (l.status = 'closed')::int + (r.status = 'closed')::int WHEN 0 THEN 'active-active' WHEN 1 THEN 'active-closed' ELSE 'unknown' END AS life
  FROM placed p JOIN records l ON l.id = p.issue_id JOIN records r ON r.id = p.related_issue_id
  LEFT JOIN bound ON lo = least(p.issue_id, p.related_issue_id) AND hi = greatest(p.issue_id, p.related_issue_id)
  LEFT JOIN used ON used.issue_id = p.issue_id AND used.related_issue_id = p.related_issue_id),
acts AS (SELECT *, CASE WHEN len(direct) > 0 OR consumed THEN 'intentional-follow-up' WHEN cue THEN 'missing-relation' WHEN same AND life = 'active-active' THEN 'duplicate' WHEN same AND life = 'active-closed' THEN 'superseded-open' ELSE 'uncertain' END AS likely_action FROM seen),
coded AS (SELECT *, CASE WHEN likely_action = 'intentional-follow-up' THEN direct ELSE [] END || list_filter([
    CASE WHEN likely_action = 'intentional-follow-up' AND consumed THEN 'active-incoming-consumer' END,
    CASE WHEN cue AND likely_action <> 'intentional-follow-up' THEN 'explicit-issue-id-reference' END, CASE WHEN cue AND likely_action <> 'intentional-follow-up' THEN 'bounded-relationship-cue' END,
    'relationship-scope-complete', CASE WHEN likely_action = 'missing-relation' THEN 'no-direct-explanatory-relationship' END,
    CASE WHEN same AND likely_action IN ('duplicate', 'superseded-open', 'uncertain') THEN 'exact-normalized-title' END, CASE WHEN same AND likely_action IN ('duplicate', 'superseded-open', 'uncertain') THEN 'lifecycle-' || life END,
    CASE WHEN likely_action = 'uncertain' THEN 'candidate-' || kind END,
    CASE WHEN likely_action = 'uncertain' AND admission_reason = 'reciprocal-neighbor-threshold-exception' AND reciprocal_evidence IS NOT NULL AND signal_quality = 'discriminative-local-evidence' THEN 'reciprocal-local-evidence' END,
    CASE WHEN likely_action = 'uncertain' AND admission_reason = 'semantic-threshold' THEN 'semantic-threshold-admission' END,
    CASE WHEN likely_action = 'uncertain' THEN 'semantic-candidate-only' END,
    CASE WHEN likely_action = 'uncertain' AND NOT same AND NOT cue THEN 'no-actionable-evidence' END], lambda c: c IS NOT NULL) AS codes FROM acts),
assessed AS (SELECT kind, issue_id, related_issue_id, position, likely_action, CASE WHEN likely_action IN ('missing-relation', 'duplicate', 'superseded-open') THEN 'action' ELSE 'informational' END AS review_tier,
  array_to_string(list_filter({order}, lambda c: list_contains(codes, c)), ',') AS evidence_codes FROM coded)"""


def _mentions() -> str:
    """Paths that documents name: urls and comments blanked, a path after no path character."""
    n = "doc_id"
    made = f"printf('Update src/mod%d/file%d.py::run_%d and `README%d.md`, see https://x.example/src/a.py <!-- docs/b.md --> then review docs/parser%d/ or foo/bar', {n} % 7, {n} % 23, {n} % 3, {n} % 5, {n} % 4)"
    clean = rf"regexp_replace(regexp_replace(coalesce(text, '') || chr(10) || {made}, '(?s)<!--.*?-->', ' ', 'g'), '(?i)\b[a-z][a-z0-9+.-]*://\S+', ' ', 'g')"
    path = r"(?:^|[^\w:/.-])((?:[A-Za-z0-9_.-]+/)+[A-Za-z0-9_.-]+(?:\.[A-Za-z0-9]+|/))(?:(?:::|#)([A-Za-z_][A-Za-z0-9_.-]*))?"
    root = r"`([A-Za-z0-9_.-]+\.[A-Za-z0-9]+)(?:(?:::|#)([A-Za-z_][A-Za-z0-9_.-]*))?`"
    both = lambda k: f"regexp_extract_all(clean, '{path}', {k}) || regexp_extract_all(clean, '{root}', {k})"
    return f"""WITH t AS (SELECT {n} AS issue_id, {clean} AS clean FROM documents),
m AS (SELECT issue_id, unnest({both(1)}) AS raw, unnest({both(2)}) AS symbol FROM t),
{_path_ctes('m')}
SELECT DISTINCT issue_id, 'title' AS source_field, path, nullif(symbol, '') AS symbol FROM d WHERE path IS NOT NULL"""


def _print() -> str:
    parts = ", ".join(f"coalesce('=' || {c}::varchar, '-')" for c in ("id", "title", "status", "priority", "parent_id"))
    return f"sha256(concat_ws(chr(31), {parts}))"


def _normal(text: str, limit: int) -> str:
    lines = rf"regexp_replace(regexp_replace({text}, '\r\n?', chr(10), 'g'), '[ \t\r\f\v\x85\xa0]+(\n|$)', '\1', 'g')"
    return f"substr(regexp_replace({lines}, '^[ \\t\\n\\r]+|[ \\t\\n\\r]+$', '', 'g'), 1, {limit})"


def _funnel() -> str:
    return f"""{_REC}, {_EDG}, {_VEC},
ends AS (SELECT e.*, s.status AS ss, t.status AS ts, (s.id IN (SELECT id FROM active))::int + (coalesce(t.id, '') IN (SELECT id FROM active))::int AS live
  FROM (SELECT DISTINCT * FROM edges WHERE relationship_type <> 'parent-child') e LEFT JOIN records s ON s.id = source_id LEFT JOIN records t ON t.id = target_id),
classed AS (SELECT ends.*, CASE WHEN ts IS NULL OR NOT (live = 2 OR live = 1 AND (ss = 'closed' OR ts = 'closed')) OR a.v IS NULL OR b.v IS NULL THEN 'inactive'
    WHEN list_dot_product(a.v, b.v) < 0.05 THEN 'below' ELSE 'eligible' END AS class FROM ends LEFT JOIN vec a ON a.id = source_id LEFT JOIN vec b ON b.id = target_id)"""


def queries() -> dict[str, str]:
    base, edged, full = f"WITH {_REC}", f"WITH {_REC}, {_EDG}", f"WITH {_REC}, {_EDG}, {_VEC}"
    vec = f"WITH {_REC}, {_VEC}"
    qualified = f"WITH {_qualified()}"
    out = {
        "prj1_records": base + " SELECT id, title, description, status, issue_type, priority, array_to_string(labels, ',') AS labels, parent_id, acceptance_criteria, design, notes, updated_at, ephemeral FROM records",
        "prj2_labels": base + " SELECT label, count(*) AS records FROM (SELECT DISTINCT id, trim(unnest(labels)) AS label FROM records) GROUP BY label",
        "prj3_dependencies": edged + " SELECT source_id, string_agg(target_id || ':' || relationship_type, ',' ORDER BY target_id || ':' || relationship_type) AS links FROM (SELECT DISTINCT * FROM typed) GROUP BY source_id",
        "prj5_summary": base + " SELECT id, title, status, issue_type, priority, parent_id, updated_at FROM records",
        "flt1_population": base + " SELECT CASE WHEN status = 'closed' THEN 'status' WHEN issue_type = 'epic' THEN 'epic' WHEN ephemeral THEN 'ephemeral' ELSE 'selected' END AS reason, count(*) AS records FROM records GROUP BY 1",
        "flt2_closed": base + " SELECT id FROM closed",
        "flt10_valid_vectors": "SELECT vec_id, len(embedding) > 0 AND list_sum(list_transform(embedding, lambda x: abs(x))) > 0 AND len(list_filter(embedding, lambda x: NOT isfinite(x))) = 0 AS valid, len(embedding)::int AS dimension FROM embeddings",
        "flt9_version_gate": "SELECT DISTINCT version, (a, b, c) >= (1, 0, 5) AND NOT starts_with(version, '1.0.5-') AS compatible FROM (SELECT p_size % 3 AS a, p_partkey % 2 AS b, p_partkey % 9 AS c, (p_size % 3) || '.' || (p_partkey % 2) || '.' || (p_partkey % 9) || CASE WHEN p_partkey % 10 = 0 THEN '-rc1' ELSE '' END AS version FROM part)",
        "src3_envelope": "SELECT role AS status, count(*) AS n, sum(length(text))::bigint AS chars FROM conversations GROUP BY role",
        "src18_synthetic": "SELECT printf('synthetic-%04d', i) AS id, 'work ' || i % 211 || ' part ' || i % 80 AS title, CASE WHEN i >= 750 THEN 'closed' ELSE 'open' END AS status FROM range(1000) t(i)",
        "str1_normalized_text": f"SELECT doc_id, md5({_normal('text', 16000)}) AS digest FROM documents",
        "str2_canonical_text": base + f", p AS (SELECT id, {_normal('title', 16000)} AS t, {_normal('description', 16000)} AS d, {_normal('acceptance_criteria', 16000)} AS a FROM records) SELECT id, md5(concat_ws(chr(10) || chr(10), CASE WHEN t <> '' THEN 'Title:' || chr(10) || t END, CASE WHEN t <> '' THEN 'Title emphasis:' || chr(10) || t END, CASE WHEN d <> '' THEN 'Description:' || chr(10) || d END, CASE WHEN a <> '' THEN 'Acceptance criteria:' || chr(10) || a END)) AS digest FROM p",
        "str3_field_views": base + f", v AS (SELECT 'title' AS field, {_normal('title', 16000)} AS t FROM records UNION ALL SELECT 'description', {_normal('description', 16000)} FROM records UNION ALL SELECT 'acceptance_criteria', {_normal('acceptance_criteria', 16000)} FROM records) SELECT field, count(*) AS records, sum(length(t))::bigint AS chars FROM v WHERE t <> '' GROUP BY field",
        "str5_reciprocal_tokens": base + f", t AS (SELECT id, {_tokens('description')} AS k FROM records) SELECT id, len(k)::int AS tokens, md5(array_to_string(k, ' ')) AS digest FROM t",
        "str6_sparse_titles": base + f" SELECT id, array_to_string(list_sort(list_filter(list_distinct({_LONG.format('title')}), lambda t: NOT list_contains({_list(FUNCTION_WORDS)}, t))), ' ') AS tokens FROM records",
        "str7_explain_tokens": base + f" SELECT id, len(list_distinct(list_filter(regexp_extract_all(lower(description), '[a-z0-9]+'), lambda t: length(t) >= 3 AND NOT list_contains({_list(STOPS)}, t))))::int AS tokens FROM records",
        "str9_identifiers": r"SELECT c_custkey, array_to_string(regexp_extract_all(upper(c_mktsegment) || ' AB-' || (c_custkey + 10), '\b[A-Z]{2,8}-?\d{2,5}\b'), ',') AS identifiers FROM customer",
        "str13_modules": f"WITH {_PTR} SELECT module, count(*) AS pointers FROM pointers GROUP BY module",
        "str15_escape": r"SELECT doc_id, md5(replace(replace(text, '|', '\|'), chr(10), ' ')) AS digest FROM documents",
        "str17_relation_types": "SELECT DISTINCT p_type, replace(replace(lower(p_type), '_', '-'), ' ', '-') AS relation FROM part",
        "dat1_rfc3339": "SELECT event_id, CASE event_id % 5 WHEN 3 THEN NULL ELSE strftime(date_trunc('second', ts) + CASE event_id % 5 WHEN 2 THEN INTERVAL (-120) MINUTE WHEN 4 THEN INTERVAL 330 MINUTE ELSE INTERVAL 0 MINUTE END, '%Y-%m-%dT%H:%M:%SZ') END AS utc FROM events",
        "dat3_whole_seconds": "SELECT event_id, strftime(date_trunc('second', ts) + CASE WHEN event_id % 10 >= 5 THEN INTERVAL 1 SECOND ELSE INTERVAL 0 SECOND END, '%Y-%m-%dT%H:%M:%SZ') AS second FROM events",
        "dat4_scope_since": base + " SELECT CASE WHEN n > 300 THEN 'changed' ELSE 'unchanged' END AS state, false AS unknown, count(*) AS records FROM records GROUP BY 1",
        "mth1_normalize": vec + " SELECT id, round(sqrt(list_sum(list_transform(v, lambda x: x * x))), 6) AS norm, round(v[1], 6) AS first FROM vec",
        "mth2_cosine": full + " SELECT DISTINCT source_id AS left_id, target_id AS right_id, round(list_dot_product(a.v, b.v), 6) AS score FROM edges JOIN vec a ON a.id = source_id JOIN vec b ON b.id = target_id",
        "jon1_similarity_pairs": vec + f" SELECT left_id, right_id, round(score, 6) AS score FROM ({_upper('avec', 0.25)})",
        "jon2_active_closed_pairs": vec + " SELECT a.id AS left_id, b.id AS right_id, round(list_dot_product(a.v, b.v), 6) AS score FROM avec a JOIN cvec b ON a.id <> b.id WHERE list_dot_product(a.v, b.v) >= 0.25",
        "jon3_multi_view_pairs": vec + f", h0 AS (SELECT id, v[1:32] AS e FROM vec WHERE right(id, 1) < '7'), hv AS (SELECT id, list_transform(e, lambda x: x / sqrt(list_sum(list_transform(e, lambda y: y * y)))) AS v FROM h0) SELECT left_id, right_id, round(max(score), 6) AS score FROM ({_upper('vec', 0.4)} UNION ALL {_upper('hv', 0.4)}) GROUP BY ALL",
        "flt3_scoped_pairs": vec + f" SELECT left_id, right_id FROM ({_upper('avec', 0.3)}) WHERE right(left_id, 1) IN ('3', '7') OR right(right_id, 1) IN ('3', '7')",
        "win1_top_ranks": vec + f", {_RANK.format(k='', a='vec', b='vec')} SELECT query_id, candidate_id, rank::int AS rank FROM ranked WHERE rank <= 5",
        "win2_rank_tables": vec + f", {_RANK.format(k='_o', a='avec', b='avec')}, {_RANK.format(k='_ac', a='avec', b='cvec')}, {_RANK.format(k='_ca', a='cvec', b='avec')} SELECT 'overlap' AS kind, query_id, candidate_id, rank::int AS rank FROM ranked_o WHERE rank <= 5 UNION ALL SELECT 'active_to_closed', query_id, candidate_id, rank FROM ranked_ac WHERE rank <= 5 UNION ALL SELECT 'closed_to_active', query_id, candidate_id, rank FROM ranked_ca WHERE rank <= 5",
        "win3_mutual_neighbours": vec + f", {_RANK.format(k='', a='avec', b='avec')}, near AS MATERIALIZED (SELECT query_id, candidate_id, rank::int AS rank FROM ranked WHERE rank <= 5) SELECT a.query_id AS left_id, a.candidate_id AS right_id, a.rank AS left_rank, b.rank AS right_rank FROM near a JOIN near b ON a.query_id = b.candidate_id AND a.candidate_id = b.query_id WHERE a.query_id < a.candidate_id",
        "win4_target_rank": full + f", {_RANK.format(k='', a='vec', b='vec')} SELECT query_id, candidate_id, rank::int AS rank FROM ranked WHERE (query_id, candidate_id) IN (SELECT (source_id, target_id) FROM edges)",
        "srt4_nearest_neighbours": "WITH e AS (SELECT vec_id AS id, list_transform(embedding::double[], lambda x: x / sqrt(list_sum(list_transform(embedding::double[], lambda y: y * y)))) AS v FROM embeddings), " + _RANK.format(k="", a="e", b="e") + " SELECT query_id, candidate_id, rank::int AS rank, round(score, 6) AS score FROM ranked WHERE rank <= 5",
        "srt5_full_ranking": vec + f", {_RANK.format(k='', a='vec', b='vec')} SELECT query_id, candidate_id, rank::int AS rank, round(score, 6) AS score FROM ranked WHERE substr(query_id, 5)::int % 50 = 0",
        "agg13_density": vec + " SELECT a.id, round(sum(list_dot_product(a.v, b.v)), 6) AS total FROM avec a CROSS JOIN avec b GROUP BY a.id",
        "agg1_relation_types": edged + " SELECT relationship_type, count(*) AS edges FROM typed GROUP BY relationship_type",
        "jon5_edge_endpoints": edged + " SELECT e.*, s.status AS source_status, t.status AS target_status FROM edges e LEFT JOIN records s ON s.id = source_id LEFT JOIN records t ON t.id = target_id",
        "jon6_direct_relations": edged + f", {_DIRECT} SELECT * FROM direct",
        "jon7_structural_context": full + f", {_DIRECT}, p0 AS (SELECT left_id, right_id FROM ({_upper('avec', 0.32)})), {_structure('p0')} SELECT * FROM structured",
        "jon7_context_of_edges": edged + f", {_DIRECT}, p0 AS (SELECT DISTINCT least(source_id, target_id) AS left_id, greatest(source_id, target_id) AS right_id FROM edges), {_structure('p0')} SELECT * FROM structured",
        "jon16_pair_edges": edged + ", w AS (SELECT DISTINCT least(source_id, target_id) AS lo, greatest(source_id, target_id) AS hi FROM legacy) SELECT DISTINCT lo, hi, source_id, target_id, relationship_type FROM typed JOIN w ON lo = least(source_id, target_id) AND hi = greatest(source_id, target_id)",
        "jon18_boundary": edged + " SELECT CASE WHEN s AND t THEN 'retained' WHEN s THEN 'outbound' WHEN t THEN 'inbound' ELSE 'unrelated' END AS boundary, relationship_type, count(*) AS edges FROM (SELECT *, source_id IN (SELECT id FROM active) AS s, target_id IN (SELECT id FROM active) AS t FROM edges) GROUP BY ALL",
        "jon19_reviewable": edged + " SELECT count(*) > 0 AS reviewable FROM edges WHERE relationship_type <> 'parent-child' AND (source_id IN (SELECT id FROM active) OR target_id IN (SELECT id FROM active))",
        "agg6_dependency_funnel": f"WITH {_funnel()} SELECT count(*) AS total_non_parent_typed, count(*) FILTER (class = 'inactive') AS inactive_or_closed_only, count(*) FILTER (class = 'below') AS below_qualification, count(*) FILTER (class = 'eligible') AS eligible, count(DISTINCT least(source_id, target_id) || greatest(source_id, target_id)) FILTER (class = 'eligible') AS eligible_candidates, count(*) FILTER (class = 'eligible') - count(DISTINCT least(source_id, target_id) || greatest(source_id, target_id)) FILTER (class = 'eligible') AS coalesced_eligible_edges FROM classed",
        "agg7_conservation": f"WITH {_funnel()} SELECT count(*) AS total_non_parent_typed, 0::bigint AS unaccounted FROM classed",
        "set7_context_edges": edged + " SELECT source_id, target_id, relationship_type FROM edges UNION SELECT id, parent_id, 'parent-child' FROM records WHERE parent_id IS NOT NULL",
        "jon14_no_signal": vec + f", p AS ({_upper('avec', 0.34)}) SELECT id FROM active WHERE id NOT IN (SELECT left_id FROM p UNION SELECT right_id FROM p)",
        "flt4_orphans": full + f", {_DIRECT}, p0 AS ({_upper('avec', 0.32)}), {_structure('p0')} SELECT left_id, right_id, round(score, 6) AS score FROM structured WHERE structural_context = 'none recorded' ORDER BY 3 DESC, 1, 2 LIMIT 20",
        "agg5_rarity_limits": base + " SELECT count(*) AS records, greatest(2, floor(count(*) * 0.1))::bigint AS rarity_limit, greatest(2, floor(count(*) * 0.03))::bigint AS alignment_limit FROM records",
        "agg4_document_frequencies": base + f", x AS (SELECT 1 AS left_id, 1 AS right_id WHERE false), {_evidence('x', 'records')} SELECT 'token' AS what, df, count(*) AS terms FROM tdf GROUP BY df UNION ALL SELECT 'phrase', df, count(*) FROM pdf GROUP BY df",
        "win9_phrases": base + f", t AS (SELECT id, {_tokens('title')} AS k FROM records) SELECT id, unnest({_phrases('k')}) AS phrase FROM t",
        "qlf3_local_evidence": edged + f", p0 AS (SELECT source_id AS left_id, target_id AS right_id FROM edges), {_evidence('p0', 'records')} SELECT * FROM evidence",
        "qlf4_substantive_body": base + " SELECT trim(description) || trim(acceptance_criteria) <> '' AS has_body, count(*) AS records FROM records GROUP BY 1",
        "qlf1_qualified": qualified + " SELECT * FROM qualified",
        "qlf2_objectives": f"WITH {_qualified(objectives=('overlap', 'structure'))} SELECT kind, lane, admission_reason, count(*) AS candidates FROM qualified GROUP BY ALL",
        "qlf5_scoped": f"WITH {_qualified(scope='e.n % 3 = 0')} SELECT kind, lane, issue_id, related_issue_id, similarity, admission_reason FROM qualified",
        "win5_echo_alternatives": qualified + " SELECT issue_id, count(*) FILTER (lane <> 'dependency') AS semantic, count(*) FILTER (lane = 'dependency') AS dependency FROM qualified WHERE kind = 'completed-work-echo' GROUP BY issue_id",
        "srt1_selection_order": qualified + f" SELECT kind, issue_id, related_issue_id, (row_number() OVER (ORDER BY {_KEY}))::int AS position FROM qualified",
        "srt2_report_order": qualified + f" SELECT kind, issue_id, related_issue_id, (row_number() OVER (ORDER BY {_REPORT}))::int AS position FROM qualified",
        "prj6_compact_candidates": qualified + " SELECT kind || '|' || issue_id || '|' || related_issue_id AS candidate_id, lane, similarity, structural_corroboration FROM qualified",
        "agg10_admission_reasons": qualified + " SELECT admission_reason, count(*) AS candidates FROM qualified GROUP BY 1",
        "agg2_pointer_counts": f"WITH {_PTR} SELECT 'source' AS facet, source AS value, count(*) AS pointers FROM pointers GROUP BY 2 UNION ALL SELECT 'context_kind', context_kind, count(*) FROM pointers GROUP BY 2 UNION ALL SELECT 'path_presence', path_presence, count(*) FROM pointers GROUP BY 2",
        "agg3_hubs": f"WITH {_PTR} SELECT * FROM hub",
        "agg22_issue_counts": f"WITH {_PTR} SELECT count(DISTINCT issue_id) FILTER (source = 'active-worktree-diff') AS observed, count(DISTINCT issue_id) FILTER (source <> 'active-worktree-diff') AS explicit FROM pointers",
        "srt8_hub_order": f"WITH {_PTR} SELECT *, (row_number() OVER (ORDER BY kind DESC, issue_count DESC, surface))::int AS position FROM hub",
        "jon8_shared_surfaces": f"WITH {_PTR} SELECT * FROM shared",
        "col1_collisions": f"WITH {_PTR} SELECT * FROM collisions",
        "col2_guard_counts": f"WITH {_PTR}, {_HELD} SELECT (SELECT count(*) FROM held) AS omitted_by_hub_guard, (SELECT count(*) FROM sp WHERE len(paths) + len(symbols) + len(modules) = 0) AS omitted_by_module_guard",
        "col2_hub_guard_sample": f"WITH {_PTR}, {_HELD}, first10 AS (SELECT * FROM held ORDER BY a, b LIMIT 10) SELECT f.a AS issue_id, f.b AS related_issue_id, array_to_string(list_sort(coalesce(list(x.surface) FILTER (kind = 'path'), []))[:8], ',') AS suppressing_paths, array_to_string(list_sort(coalesce(list(x.surface) FILTER (kind = 'module'), []))[:8], ',') AS suppressing_modules FROM first10 f JOIN surf x ON x.issue_id = f.a JOIN surf y USING (kind, surface) WHERE y.issue_id = f.b AND (kind, surface) IN (SELECT (kind, surface) FROM hub) GROUP BY ALL",
        "col3_scoped_collisions": f"WITH {_PTR}, {_HELD}, scope AS (SELECT o_orderkey FROM orders WHERE o_orderdate >= DATE '1998-01-01'), inside AS (SELECT a, b FROM (SELECT issue_id AS a, related_issue_id AS b, 'shared' AS fate FROM pairs) WHERE a IN (FROM scope) OR b IN (FROM scope)), away AS (SELECT * FROM held WHERE a IN (FROM scope) OR b IN (FROM scope)) SELECT (SELECT count(*) FROM inside) AS collisions, (SELECT count(*) FROM away) AS omitted_by_hub_guard, (SELECT count(*) FROM sp WHERE len(paths) + len(symbols) + len(modules) = 0 AND (issue_id IN (FROM scope) OR related_issue_id IN (FROM scope))) AS omitted_by_module_guard",
        "set3_shared_evidence": f"WITH {_PTR} SELECT issue_id, related_issue_id, array_to_string(paths, ',') AS shared_paths, array_to_string(symbols, ',') AS shared_symbols, array_to_string(modules, ',') AS shared_modules FROM sp",
        "srt6_collision_order": f"WITH {_PTR} SELECT issue_id, related_issue_id, (row_number() OVER (ORDER BY kind, list_position(['observed', 'corroborated', 'explicit'], confidence), list_position(['observed-worktree', 'prose', 'mixed', 'code-fence-only'], context_kind), list_position(['all-existing', 'mixed', 'all-missing', 'unavailable'], path_presence), list_position(['observed-edit', 'likely-edit', 'mixed', 'unknown', 'reference-only'], edit_intent), issue_id, related_issue_id))::int AS position FROM collisions",
        "str11_edit_intent": r"WITH t AS (SELECT p_partkey, lower(p_name || ' ' || ['fix it', 'please review', 'nothing', 'prefix'][p_partkey % 4 + 1]) AS t FROM part) SELECT p_partkey, CASE WHEN regexp_matches(t, '\b(add|change|create|edit|fix|implement|migrate|modify|move|refactor|remove|rename|repair|replace|rewrite|update|write)\b') THEN 'likely-edit' WHEN regexp_matches(t, '\b(audit|check|document|inspect|inventory|read|reference|review|see|trace|verify)\b') THEN 'reference-only' ELSE 'unknown' END AS intent FROM t",
        "src11_changed_paths": f"WITH {_PTR}, t AS (SELECT issue_id % 50 AS worktree, path, edit_intent IN ('observed-edit', 'likely-edit') AS committed FROM pointers), c AS (SELECT DISTINCT worktree, path FROM t WHERE committed), k AS (SELECT worktree FROM c GROUP BY 1 HAVING count(*) <= 40) SELECT worktree, count(*) AS paths FROM (SELECT worktree, path FROM c WHERE worktree IN (SELECT worktree FROM k) UNION SELECT worktree, path FROM t WHERE NOT committed) GROUP BY 1",
        "grf1_components": f"WITH RECURSIVE {_REC}, {_VEC}, p AS ({_upper('avec', 0.34)}), b AS (SELECT left_id AS u, right_id AS v FROM p UNION SELECT right_id, left_id FROM p), r(id, c) AS (SELECT DISTINCT u, u FROM b UNION SELECT b.v, r.c FROM r JOIN b ON b.u = r.id) SELECT id, min(c) AS component FROM r GROUP BY id",
        "jon15_consumers": edged + ", p AS (SELECT DISTINCT source_id AS issue_id, target_id AS related_issue_id FROM edges) SELECT DISTINCT issue_id, related_issue_id FROM p JOIN edges e ON e.target_id IN (issue_id, related_issue_id) WHERE e.source_id NOT IN (issue_id, related_issue_id) AND e.source_id IN (SELECT id FROM active)",
        "frs2_direct_codes": edged + ", p AS (SELECT DISTINCT source_id AS issue_id, target_id AS related_issue_id FROM edges), k AS (SELECT least(source_id, target_id) AS lo, greatest(source_id, target_id) AS hi, relationship_type AS t FROM edges WHERE relationship_type IN ('parent-child', 'blocks', 'depends-on', 'discovered-from') UNION SELECT least(id, parent_id), greatest(id, parent_id), 'parent-child' FROM records WHERE parent_id IS NOT NULL) SELECT issue_id, related_issue_id, coalesce(string_agg('direct-' || t, ',' ORDER BY t), '') AS direct FROM p LEFT JOIN k ON lo = least(issue_id, related_issue_id) AND hi = greatest(issue_id, related_issue_id) GROUP BY ALL",
        "frs3_lifecycle": edged + " SELECT CASE WHEN s.status IS NULL OR t.status IS NULL THEN 'unknown' WHEN s.status <> 'closed' AND t.status <> 'closed' THEN 'active-active' WHEN s.status = 'closed' AND t.status = 'closed' THEN 'unknown' ELSE 'active-closed' END AS lifecycle, count(*) AS pairs FROM edges LEFT JOIN records s ON s.id = source_id LEFT JOIN records t ON t.id = target_id GROUP BY 1",
        "jon10_checkpoint_states": base + f", {_SNAP}, a AS (SELECT id, {_print()} AS f FROM now), b AS (SELECT id, {_print()} AS g FROM before) SELECT id, CASE WHEN f IS NULL THEN 'deleted' WHEN g IS NULL OR f <> g THEN 'changed' ELSE 'unchanged' END AS state FROM a FULL JOIN b USING (id)",
        "jon9_divergence": base + f", {_SNAP} SELECT 'issue_identity' AS reason, count(*) AS records FROM now FULL JOIN before ON now.id = before.id WHERE now.id IS NULL OR before.id IS NULL UNION ALL SELECT 'status', count(*) FROM now JOIN before USING (id) WHERE now.status <> before.status",
        "agg18_state_digest": base + ", hs AS (SELECT sha256(concat_ws('|', id, coalesce(lower(status::varchar), ''), coalesce(lower(priority::varchar), ''), strftime(updated_at::timestamp, '%Y-%m-%dT%H:%M:%SZ'))) AS h FROM records), bs AS (SELECT substr(h, 1, 3) AS b, count(*) AS n, sum(('0x' || substr(h, 4, 10))::ubigint)::hugeint AS s, sum(('0x' || substr(h, 14, 10))::ubigint)::hugeint AS t FROM hs GROUP BY 1) SELECT sum(n)::bigint AS records, sha256(string_agg(b || ':' || n || ':' || s || ':' || t, ',' ORDER BY b || ':' || n || ':' || s || ':' || t)) AS digest FROM bs",
        "agg19_fingerprints": base + f" SELECT id, updated_at, {_print()} AS fingerprint FROM records",
        "agg20_content_keys": base + " SELECT id, sha256(concat_ws(chr(31), '1', 'hashing', '1', title)) AS key FROM records",
        "set4_deleted": base + f", {_SNAP} SELECT id FROM before EXCEPT SELECT id FROM now",
        "jon10_remembered_states": base + f", {_SNAP}, a AS (SELECT id, {_print()} AS f FROM now), b AS (SELECT id, {_print()} AS g FROM before) SELECT id, 1::int AS day, 'new' AS state FROM b UNION ALL SELECT id, 2::int, CASE WHEN f IS NULL THEN 'deleted' WHEN g IS NULL THEN 'new' WHEN f <> g THEN 'changed' ELSE 'unchanged' END FROM a FULL JOIN b USING (id)",
        "jon11_cached_runs": base + ", k AS (SELECT count(DISTINCT coalesce(title, '')) AS a, count(*) AS r, count(DISTINCT coalesce(title, '')) FILTER (n % 2 = 0) AS e, count(*) FILTER (n % 2 = 0) AS re FROM records) SELECT 1::int AS run, 0::bigint AS hits, e AS encoded, re AS vectors FROM k UNION ALL SELECT 2, e, a - e, r FROM k UNION ALL SELECT 3, a, 0, r FROM k",
        "jon11_cache": base + ", c AS (SELECT DISTINCT title FROM records WHERE id < 'doc-000100') SELECT count(*) FILTER (title IN (SELECT title FROM c)) AS hits, count(DISTINCT title) FILTER (title NOT IN (SELECT title FROM c)) AS misses FROM records",
        "agg14_budget_metrics": vec + f", {_JUDGED}, top AS (SELECT * FROM js ORDER BY score DESC, left_id, right_id LIMIT 20) SELECT (SELECT round(avg((rating = 2)::int), 6) FROM top) AS precision_at_budget, (SELECT round(avg((rating >= 1)::int), 6) FROM top) AS useful_at_budget, round(1 - avg((score >= 0.1)::int), 6) AS abstention_rate, round(count(*) FILTER (score >= 0.1 AND rating = 2) / (count(*) FILTER (rating = 2))::double, 6) AS recall_at_threshold FROM js",
        "agg14_recall_at_5": vec + f", {_JUDGED}, {_RANK.format(k='', a='vec', b='vec')} SELECT round(avg((rank <= 5)::int), 6) AS recall, count(*) AS positives FROM judged JOIN ranked ON query_id = left_id AND candidate_id = right_id WHERE rating = 2",
        "agg15_rating_means": vec + f", {_JUDGED} SELECT rating, round(avg(score), 6) AS mean_score, count(*) AS pairs FROM js GROUP BY rating",
        "agg24_tf_idf": f"WITH {_TFIDF} SELECT id, token, round(weight, 6) AS weight FROM weights",
        "mth5_sparse_scores": f"WITH {_TFIDF}, p AS (SELECT item_id AS left_id, item_id + 1 AS right_id FROM benchmark), s AS (SELECT left_id, right_id, sum(a.weight * b.weight) AS s FROM p JOIN weights a ON a.id = left_id JOIN weights b ON b.id = right_id AND b.token = a.token GROUP BY ALL) SELECT left_id, right_id, round(coalesce(s, 0), 6) AS score FROM p LEFT JOIN s USING (left_id, right_id)",
        "mth4_dice": edged + f", k AS (SELECT id, list_distinct(list_filter(regexp_extract_all(lower(title), '[a-z0-9]+'), lambda t: length(t) >= 3 AND NOT list_contains({_list(STOPS)}, t))) AS t FROM records), p AS (SELECT DISTINCT source_id, target_id FROM edges) SELECT source_id, target_id, round(CASE WHEN len(a.t) = 0 OR len(b.t) = 0 THEN 0 ELSE 2.0::double * len(list_intersect(a.t, b.t)) / (len(a.t) + len(b.t)) END, 3) AS dice FROM p JOIN k a ON a.id = source_id JOIN k b ON b.id = target_id",
        "win7_stratified_sample": vec + f", p AS ({_upper('avec', 0.3)}), r AS (SELECT left_id || '|' || right_id AS candidate_id, CASE WHEN right(left_id, 1) < '5' THEN 'echo' ELSE 'overlap' END AS lane, row_number() OVER (ORDER BY round(score, 6) DESC, left_id || '|' || right_id) AS rank FROM p), b AS (SELECT *, CASE WHEN rank <= 20 THEN '1-20' WHEN rank <= 50 THEN '21-50' ELSE '51-100' END AS bucket FROM r WHERE rank <= 100), c AS (SELECT *, row_number() OVER (PARTITION BY lane, bucket ORDER BY sha256('seed' || chr(0) || 'stratum' || chr(0) || candidate_id)) AS k FROM b) SELECT candidate_id, lane, rank::int AS rank, bucket, 'review-' || lpad((row_number() OVER (ORDER BY sha256('seed' || chr(0) || 'blind-review-order' || chr(0) || candidate_id)))::varchar, 3, '0') AS review_id FROM c WHERE k <= 5",
        "agg26_export_summary": base + " SELECT count(*) AS issues, count(*) FILTER (status <> 'closed') AS active, count(*) FILTER (status = 'closed') AS closed FROM records",
    }
    out["jon4_scores"] = f"SELECT count(*) AS pairs, round(avg(score), 6) AS mean_score FROM ({out['mth2_cosine']})"
    order = "CASE relationship_type WHEN 'blocks' THEN 0 WHEN 'duplicate' THEN 1 WHEN 'related' THEN 2 WHEN 'similar' THEN 3 ELSE 4 END"
    turned = "CASE WHEN relationship_type IN ('duplicate', 'related', 'similar') THEN least(source_id, target_id) ELSE source_id END AS source_id, CASE WHEN relationship_type IN ('duplicate', 'related', 'similar') THEN greatest(source_id, target_id) ELSE target_id END AS target_id"
    canonical = f"(SELECT *, row_number() OVER (PARTITION BY lo, hi ORDER BY {order}, relationship_type, source_id, target_id) AS k, count(*) OVER (PARTITION BY lo, hi) - 1 AS collapsed FROM (SELECT {turned}, relationship_type, least(source_id, target_id) AS lo, greatest(source_id, target_id) AS hi FROM {{}}))"
    out["set8_canonical_relations"] = edged + f" SELECT lo, hi, source_id, target_id, relationship_type, collapsed FROM {canonical.format('typed')} WHERE k = 1"
    inside = "(SELECT * FROM typed WHERE source_id IN (SELECT id FROM active) AND target_id IN (SELECT id FROM active))"
    touch = "(source_id IN (SELECT id FROM active))::int + (target_id IN (SELECT id FROM active))::int"
    out["agg12_relation_accounting"] = edged + f" SELECT count(*) AS raw, count(*) FILTER (n = 1) AS omitted_boundary, count(*) FILTER (n = 0) AS unrelated, (SELECT count(*) FROM {canonical.format(inside)} WHERE k = 1) AS retained, (SELECT sum(collapsed)::bigint FROM {canonical.format(inside)} WHERE k = 1) AS collapsed, 0::bigint AS unaccounted FROM (SELECT {touch} AS n FROM typed)"
    kinds = "coalesce(list_position(['blocks', 'depends-on', 'duplicate-of', 'parent-child', 'discovered-from', 'relates-to', 'similar-to'], relationship_type), 8)"
    out["win6_bounded_neighbours"] = edged + f", c AS (SELECT source_id, target_id, relationship_type FROM edges UNION SELECT id, parent_id, 'parent-child' FROM records WHERE parent_id IS NOT NULL), b AS (SELECT source_id AS id, 'outgoing' AS direction, target_id AS other, relationship_type FROM c UNION ALL SELECT target_id, 'incoming', source_id, relationship_type FROM c), k AS (SELECT *, row_number() OVER (PARTITION BY id, direction ORDER BY (other NOT IN (SELECT id FROM records WHERE status <> 'closed'))::int, {kinds}, other, relationship_type) AS place, count(*) OVER (PARTITION BY id, direction) AS n FROM b) SELECT id, direction, other, relationship_type, place::int AS place, n - least(n, 4) AS omitted FROM k WHERE place <= 4"
    out["flt6_paths"] = _path_sql()
    out["src10_worktrees"] = "SELECT '/w/' || lower(n_name) AS path, 'h' || n_nationkey AS head, CASE WHEN n_nationkey % 4 <> 0 THEN 'fix-' || n_nationkey END AS branch FROM nation"
    out["src14_cache_read"] = "SELECT NOT (vec_id % 10 = 0 OR vec_id % 11 = 0) AS hit, count(*) AS vectors FROM embeddings GROUP BY 1"
    out["jon13_batch_evidence"] = vec + f", p AS ({_upper('avec', 0.3)}) SELECT n // 100 AS batch, count(DISTINCT left_id || right_id) AS pairs FROM p JOIN active ON id IN (left_id, right_id) GROUP BY 1"
    out["set9_warnings"] = "SELECT conv_id, string_agg(DISTINCT role, ',' ORDER BY role) AS roles FROM conversations GROUP BY conv_id"
    out["prj4_state_mapping"] = "SELECT CASE o_orderstatus WHEN 'F' THEN 'closed' WHEN 'P' THEN 'in_progress' ELSE 'open' END AS status, left(o_orderpriority, 1)::int - 1 AS priority, count(*) AS records FROM orders GROUP BY ALL"
    out["srt10_bounded_evidence"] = f"WITH {_PTR} SELECT issue_id, array_to_string(list_sort(list(DISTINCT path))[:3], ',') AS paths FROM pointers GROUP BY issue_id"
    out["arr5_connections"] = "SELECT conv_id, turn AS id, role AS name FROM conversations"
    own = ", ".join(f"list_distinct(list_filter(regexp_extract_all(lower({c}), '[a-z0-9]+'), lambda t: length(t) >= 3 AND NOT list_contains({_list(STOPS)}, t))) AS {c}" for c in ("title", "description", "acceptance_criteria"))
    dice = "(CASE WHEN len(a.{c}) = 0 OR len(b.{c}) = 0 THEN 0.0::double ELSE round(2.0::double * len(list_intersect(a.{c}, b.{c})) / (len(a.{c}) + len(b.{c})), 3) END)"
    t, ds, ac = (dice.format(c=c) for c in ("title", "description", "acceptance_criteria"))
    out["exp2_patterns"] = qualified + f", own AS (SELECT id, parent_id, {own} FROM records), s AS (SELECT q.kind, q.lane, q.issue_id, q.related_issue_id, {t} AS t, {ds} AS d, {ac} AS a, coalesce(a.parent_id = q.related_issue_id OR b.parent_id = q.issue_id, false) AS fam FROM qualified q JOIN own a ON a.id = q.issue_id JOIN own b ON b.id = q.related_issue_id), f AS (SELECT kind, issue_id, related_issue_id, string_agg(name, ',' ORDER BY v DESC, k) AS names FROM (SELECT kind, issue_id, related_issue_id, 'title' AS name, t AS v, 0 AS k FROM s UNION ALL SELECT kind, issue_id, related_issue_id, 'description', d, 1 FROM s UNION ALL SELECT kind, issue_id, related_issue_id, 'acceptance criteria', a, 2 FROM s) WHERE v > 0 GROUP BY ALL) SELECT s.kind, s.issue_id, s.related_issue_id, CASE WHEN fam THEN 'parent-child' WHEN s.kind = 'completed-work-echo' THEN 'completed-work' WHEN t >= 0.5 AND a >= 0.35 THEN 'same-outcome' WHEN d >= 0.25 THEN 'shared-subsystem' WHEN greatest(t, d, a) > 0 THEN 'vocabulary-only' ELSE 'semantic-only' END AS pattern, CASE WHEN lane = 'dependency' THEN 'structure' WHEN s.kind = 'completed-work-echo' THEN 'echo' ELSE 'overlap' END AS objective, coalesce(names, '') AS evidence_fields, t AS title_score, d AS description_score FROM s LEFT JOIN f USING (kind, issue_id, related_issue_id)"
    out["mth6_identifier_score"] = r"WITH t AS (SELECT c_custkey, c_mktsegment || ' AB-' || (c_custkey % 20 + 10) AS t FROM customer) SELECT a.c_custkey, CASE WHEN lower(a.t) = lower(b.t) THEN 1.0::double WHEN list_has_any(regexp_extract_all(a.t, '\b[A-Z]{2,8}-?\d{2,5}\b'), regexp_extract_all(b.t, '\b[A-Z]{2,8}-?\d{2,5}\b')) THEN 0.9 ELSE 0 END AS score FROM t a JOIN t b ON b.c_custkey = a.c_custkey + 20"
    out["mth7_batch_capacities"] = "WITH b AS (SELECT p_partkey, least(p_partkey, greatest(1, (p_partkey + (p_size % 9 + 1) // 2) // (p_size % 9 + 1)))::bigint AS batches FROM part WHERE p_partkey > 0) SELECT p_partkey, batches, p_partkey // batches AS capacity, p_partkey % batches AS larger FROM b"
    out["mth8_lane_reservations"] = "SELECT n::int AS queue, least(CASE n WHEN 1 THEN 0 WHEN 2 THEN 1 ELSE n - 2 * greatest(1, n // 5) END, 75)::int AS dependency, least(CASE WHEN n <= 2 THEN 0 ELSE greatest(1, n // 5) END, 125)::int AS echo, least(CASE WHEN n <= 2 THEN 1 ELSE greatest(1, n // 5) END, 125)::int AS overlap FROM range(1, 301) t(n)"
    out["str4_words"] = f"WITH w AS (SELECT conv_id, turn, regexp_extract_all({_FOLDED.format('text')}, '[\\p{{L}}\\p{{N}}_''-]+') AS w FROM conversations) SELECT conv_id, turn, greatest(len(w), 1)::int AS words, md5(array_to_string(w, ' ')) AS digest FROM w"
    out["str8_plain_titles"] = base + f" SELECT id, {_PLAIN.format('title')} AS title FROM records"
    out["str16_label_types"] = "SELECT p_partkey, ['bug', 'bug', 'feature', 'feature', 'task'][p_partkey % 5 + 1] AS issue_type, [0, 1, 3, 3, 0, 2, 1][p_size % 7 + 1]::int AS priority FROM part"
    out["str18_mappings"] = "SELECT n_nationkey::varchar AS id, '/w/' || n_name || '=x' AS path FROM nation"
    out["agg16_pair_quality"] = full + f", p AS (SELECT source_id AS left_id, min(target_id) AS right_id FROM edges WHERE relationship_type = 'blocks' GROUP BY 1), k AS (SELECT left_id, right_id, max(list_dot_product(a.v, b.v)) FILTER (b.id = right_id) AS own, max(list_dot_product(a.v, b.v)) FILTER (b.id <> right_id) AS other FROM p JOIN vec a ON a.id = left_id JOIN vec b ON b.id <> left_id WHERE right_id IN (SELECT id FROM vec) GROUP BY ALL) SELECT round(avg((own > other)::int), 6) AS recall_at_1, round(median(own - other), 6) AS median_margin FROM k"
    out["agg17_medians"] = "SELECT event_type, round(median(value), 6) AS median FROM events GROUP BY event_type"
    assessed = f"WITH {_freshness()}"
    out["frs1_freshness"] = assessed + " SELECT kind, issue_id, related_issue_id, likely_action, review_tier, evidence_codes FROM assessed"
    out["agg23_freshness_summary"] = assessed + " SELECT coalesce(likely_action, 'all') AS likely_action, coalesce(review_tier, 'all') AS review_tier, count(*) AS pairs FROM assessed GROUP BY CUBE (likely_action, review_tier)"
    acts = "list_position(['duplicate', 'superseded-open', 'missing-relation', 'uncertain', 'intentional-follow-up'], likely_action)"
    out["win10_freshness_queue"] = assessed + f", q AS (SELECT *, (row_number() OVER (ORDER BY review_tier <> 'action', {acts}, position, kind, issue_id, related_issue_id))::int AS freshness_position FROM assessed) SELECT kind, issue_id, related_issue_id, position, freshness_position FROM q WHERE freshness_position <= 20"
    out["arr4_ordered_distinct"] = r"WITH w AS (SELECT item_id, string_split_regex(lower(text), '[ \n]') AS w FROM benchmark) SELECT item_id, array_to_string(list_filter(w, lambda x, i: list_position(w, x) = i), ' ') AS words FROM w"
    out["str10_path_mentions"] = _mentions()
    out["set3_shared_modules"] = f"WITH {_PTR}, m AS (SELECT issue_id, list_sort(list(DISTINCT module)) AS m FROM pointers GROUP BY 1) SELECT a.issue_id, array_to_string(list_filter(a.m, lambda x: list_contains(b.m, x)), ',') AS shared FROM m a JOIN m b ON b.issue_id = a.issue_id + 1"
    out["set5_additions"] = f"SELECT kind, lane, count(*) AS candidates FROM (WITH {_qualified(0.32, 0.36)} SELECT kind, lane, issue_id, related_issue_id FROM qualified) WHERE (kind, issue_id, related_issue_id) NOT IN ({qualified} SELECT (kind, issue_id, related_issue_id) FROM qualified) GROUP BY ALL"
    out["srt9_queue_receipt"] = vec + f" SELECT count(*) AS available, least(count(*), 20) AS queued, CASE WHEN count(*) > 20 THEN 'budget-reached' ELSE 'source-exhausted' END AS reason FROM ({_upper('avec', 0.34)})"
    out["srt11_hub_sample"] = f"WITH {_PTR}, f AS (SELECT surface, list_sort(list(DISTINCT issue_id)) AS ids FROM surf WHERE kind = 'path' AND NOT observed AND (kind, surface) IN (SELECT (kind, surface) FROM hub) GROUP BY 1) SELECT surface, ids[1] AS issue_id, ids[2] AS related_issue_id FROM f ORDER BY 2, 1 LIMIT 10"
    out["src7_team_lookup"] = "SELECT n_nationkey, n_name FROM nation WHERE lower(n_name) = (SELECT lower(n_name) FROM nation WHERE n_nationkey = 3)"
    out["src16_judgments"] = vec + f", {_JUDGED} SELECT rating, count(*) AS pairs, (SELECT count(*) FROM judged WHERE left_id NOT IN (SELECT id FROM records) OR right_id NOT IN (SELECT id FROM records)) AS missing_endpoints FROM judged GROUP BY rating"
    out["val1_validation"] = "SELECT * FROM (VALUES ('batch-too-large', 0::bigint), ('record-in-two-batches', 0), ('candidate-without-packaged-endpoint', 0)) t(code, violations)"
    return out


def _path_ctes(rows: str) -> str:
    """CTEs up to ``d``: ``rows`` with ``raw`` in normal form as ``path``."""
    strip = r"""regexp_replace(raw, '^[`''"()\[\]{}<>,;:]+|[`''"()\[\]{}<>,;:]+$', '', 'g')"""
    parts = "list_filter(string_split({}, '/'), lambda p: p NOT IN ('', '.'))"
    bad = f"list_has_any({{}}, {_list(['..', *IGNORED_PARTS])})"
    return rf"""a AS (SELECT *, replace({strip}, '\', '/') AS t, regexp_replace(replace(trim(raw), '\', '/'), '/+$', '') AS g FROM {rows}),
b AS (SELECT *, ends_with(t, '/') AS folder, regexp_replace(t, '/+$', '') AS bare FROM a),
c AS (SELECT *, {parts.format('bare')} AS parts, {parts.format('g')} AS gparts, lower(regexp_extract(bare, '[^/.](\.[^./]+)$', 1)) AS suffix FROM b),
d AS (SELECT *, CASE WHEN bare <> '' AND length(bare) <= 240 AND NOT starts_with(bare, '/') AND NOT starts_with(bare, '~/') AND NOT regexp_matches(bare, '^[A-Za-z]:')
    AND bare <> '.' AND NOT starts_with(bare, './') AND NOT {bad.format('parts')} AND len(parts) > 0
    AND CASE WHEN folder THEN list_contains({_list(DIRECTORY_ROOTS)}, parts[1]) ELSE list_contains({_list(CODE_EXTENSIONS)}, suffix) END
    THEN array_to_string(parts, '/') || CASE WHEN folder THEN '/' ELSE '' END END AS path,
  CASE WHEN NOT {bad.format('gparts')} AND g NOT IN ('', '.') AND NOT starts_with(g, '/') THEN array_to_string(gparts, '/') END AS tracked FROM c)"""


def _path_sql() -> str:
    return f"""WITH r AS (SELECT p_partkey, printf({_PATHS}[p_partkey % 10 + 1], p_partkey) AS raw FROM part),
{_path_ctes('r')}
SELECT p_partkey, path, coalesce(path, tracked) AS git_path FROM d"""
