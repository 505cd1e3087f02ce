"""Registry of the engine's own queries; their oracle SQL is in ``oracles``."""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon import oracles
from quillon.functions import text as T
from quillon.model import CandidatePolicy
from quillon.operators import evaluate, explain, freshness, graph, incremental, qualify, relations, selection, surfaces
from quillon.operators import vectors as V
from quillon.plans.ordering import numbered
from quillon.plans.staging import shared_path, stage
from quillon.sources import host_pages, trackers, vector_cache
from quillon.sources import records as R
from quillon.streaming import scope

Query = Callable[[SparkSession, str], DataFrame]

POLICY = CandidatePolicy(echo_threshold=0.35, overlap_threshold=0.40)
STOP_WORDS = tuple("about after also been before being between from have into only should that their then this through using when where with".split())
HUB_LIMIT = 5
_QUERIES: dict[str, Query] = {}


def query(name: str) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        _QUERIES[name] = f
        return f

    return add


class Inputs:
    """The derived relations of one run, each built where it is asked for."""

    def __init__(self, spark: SparkSession, sf_dir: str) -> None:
        self.spark, self.dir = spark, sf_dir
        self.records = R.records(spark, sf_dir)
        self.active = R.population(self.records)
        self.closed = self.records.filter(R.is_closed(F.col("status")))
        self.typed, self.legacy = R.typed_edges(spark, sf_dir), R.legacy_edges(spark, sf_dir)
        self.edges = relations.normalized_edges(self.typed, self.legacy)
        self.vectors = R.vectors(spark, sf_dir)
        self.active_vectors = self.vectors.join(self.active.select("id"), "id", "left_semi")
        self.closed_vectors = self.vectors.join(self.closed.select("id"), "id", "left_semi")

    def table(self, name: str) -> DataFrame:
        return R.table(self.spark, self.dir, name)

    def pairs(self, threshold: float = 0.32) -> DataFrame:
        return V.pairs_above(self.active_vectors, None, threshold)

    @functools.cached_property
    def ground(self) -> qualify.Ground:
        return qualify.Ground.of(self.records, self.active, self.edges, self.vectors)

    def qualified(self, policy: CandidatePolicy = POLICY, eligible: DataFrame | None = None, related_only: bool = False) -> DataFrame:
        return qualify.qualified(self.records, self.active, self.edges, self.vectors, policy, eligible, self.ground, related_only)


def _lines(df: DataFrame, *names: str) -> DataFrame:
    """Array columns as one string each."""
    return df.withColumns({n: F.array_join(n, ",") for n in names})


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _QUERIES["srt4_nearest_neighbours"](spark, sf_dir)


# --- records and fields ---------------------------------------------------------


@query("prj1_records")
def _(s, d):
    return _lines(Inputs(s, d).records.drop("n"), "labels")


@query("prj2_labels")
def _(s, d):
    rows = Inputs(s, d).records.select("id", F.explode(F.array_sort(F.array_distinct(F.transform("labels", lambda x: F.trim(x))))).alias("label"))
    return rows.groupBy("label").agg(F.count("*").alias("records"))


@query("prj3_dependencies")
def _(s, d):
    rows = Inputs(s, d).typed.filter("source_id <> target_id").distinct()
    links = F.array_sort(F.collect_list(F.concat_ws(":", "target_id", "relationship_type")))
    return rows.groupBy("source_id").agg(F.array_join(links, ",").alias("links"))


@query("prj5_summary")
def _(s, d):
    return Inputs(s, d).records.select("id", "title", "status", "issue_type", "priority", "parent_id", "updated_at")


@query("flt1_population")
def _(s, d):
    reason = F.coalesce(R.excluded_reason(), F.lit("selected")).alias("reason")
    return Inputs(s, d).records.groupBy(reason).agg(F.count("*").alias("records"))


@query("flt2_closed")
def _(s, d):
    return Inputs(s, d).closed.select("id")


@query("flt10_valid_vectors")
def _(s, d):
    rows = R.table(s, d, "embeddings")
    return rows.select("vec_id", V.normalize(F.col("embedding")).isNotNull().alias("valid"), F.size("embedding").alias("dimension"))


@query("flt9_version_gate")
def _(s, d):
    rows = R.table(s, d, "part").select(F.concat(F.col("p_size") % 3, F.lit("."), F.col("p_partkey") % 2, F.lit("."), F.col("p_partkey") % 9, F.when(F.col("p_partkey") % 10 == 0, "-rc1").otherwise("")).alias("version")).distinct()
    return rows.select("version", trackers.compatible(F.col("version")).alias("compatible"))


@query("src3_envelope")
def _(s, d):
    turns = R.table(s, d, "conversations").select(F.concat_ws("-", "conv_id", "turn").alias("id"), "role", F.length("text").alias("chars"))
    item = F.struct(F.col("id"), F.col("role").alias("status"), F.col("chars").alias("priority"))
    pages = turns.withColumn("page", F.pmod(F.crc32(F.col("id").cast("binary")), F.lit(3))).groupBy("page", F.expr("substr(id, 1, 2)").alias("k"))
    packed = pages.agg(F.to_json(F.collect_list(item)).alias("rows")).withColumn("key", F.element_at(F.array(*map(F.lit, ("issues", "items", "data"))), (F.col("page") + 1).cast("int")))
    body = packed.select(F.concat(F.lit('{"'), F.col("key"), F.lit('":'), F.col("rows"), F.lit("}")).alias("body"))
    raws = trackers.envelope(body.select(F.col("body").alias("value")))
    get = lambda k: F.get_json_object("raw", f"$.{k}")
    return raws.groupBy(get("status").alias("status")).agg(F.count("*").alias("n"), F.sum(get("priority").cast("long")).alias("chars"))


@query("src18_synthetic")
def _(s, d):
    n = F.col("id")
    rows = s.range(1000).select(F.format_string("synthetic-%04d", n).alias("id"), F.concat(F.lit("work "), n % 211, F.lit(" part "), n % 80).alias("title"), F.when(n >= 750, "closed").otherwise("open").alias("status"))
    return rows


@query("str1_normalized_text")
def _(s, d):
    return R.table(s, d, "documents").select("doc_id", F.md5(T.normalize_text(F.col("text"))).alias("digest"))


@query("str2_canonical_text")
def _(s, d):
    return Inputs(s, d).records.select("id", F.md5(T.canonical_text()).alias("digest"))


@query("str3_field_views")
def _(s, d):
    views = [F.struct(F.lit(f).alias("field"), T.normalize_text(F.col(f)).alias("text")) for f in T.FIELDS]
    rows = Inputs(s, d).records.select("id", F.explode(F.array(*views)).alias("v")).filter("v.text <> ''")
    return rows.groupBy("v.field").agg(F.count("*").alias("records"), F.sum(F.length("v.text")).alias("chars"))


@query("str5_reciprocal_tokens")
def _(s, d):
    tokens = T.reciprocal_tokens(F.col("description"))
    return Inputs(s, d).records.select("id", F.size(tokens).alias("tokens"), F.md5(F.array_join(tokens, " ")).alias("digest"))


@query("str6_sparse_titles")
def _(s, d):
    return Inputs(s, d).records.select("id", F.array_join(F.array_sort(T.sparse_title_tokens(F.col("title"))), " ").alias("tokens"))


@query("str7_explain_tokens")
def _(s, d):
    return Inputs(s, d).records.select("id", F.size(T.explain_tokens(F.col("description"), STOP_WORDS)).alias("tokens"))


@query("str9_identifiers")
def _(s, d):
    names = R.table(s, d, "customer").select("c_custkey", F.concat_ws(" ", F.upper("c_mktsegment"), F.concat(F.lit("AB-"), F.col("c_custkey") + 10)).alias("t"))
    return names.select("c_custkey", F.array_join(T.identifiers(F.col("t")), ",").alias("identifiers"))


@query("str13_modules")
def _(s, d):
    rows = _pointers(s, d)
    return rows.select(T.module_of(F.col("path")).alias("module")).groupBy("module").agg(F.count("*").alias("pointers"))


@query("str15_escape")
def _(s, d):
    return R.table(s, d, "documents").select("doc_id", F.md5(T.markdown_escape(F.col("text"))).alias("digest"))


@query("str17_relation_types")
def _(s, d):
    return R.table(s, d, "part").select("p_type", T.relation_type(F.col("p_type")).alias("relation")).distinct()


@query("dat1_rfc3339")
def _(s, d):
    e = R.table(s, d, "events")
    zone = F.element_at(F.array(*map(F.lit, ("Z", "+00:00", "+02:00", "", "-05:30"))), (F.col("event_id") % 5 + 1).cast("int"))
    text = F.concat(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss"), zone)
    return e.select("event_id", incremental.utc_text(text).alias("utc"))


@query("dat3_whole_seconds")
def _(s, d):
    e = R.table(s, d, "events")
    text = F.concat(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss"), F.lit("."), (F.col("event_id") % 10).cast("string"), F.lit("Z"))
    return e.select("event_id", F.date_format(incremental.nearest_second(text), "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("second"))


@query("dat4_scope_since")
def _(s, d):
    rows = incremental.scope_since(Inputs(s, d).records, "2024-01-01T05:00:00Z")
    return rows.groupBy("state", "unknown").agg(F.count("*").alias("records"))


# --- vectors, pairs, ranks ------------------------------------------------------


@query("mth1_normalize")
def _(s, d):
    return Inputs(s, d).vectors.select("id", F.round(V.norm(F.col("v")), 6).alias("norm"), F.round(F.element_at("v", 1), 6).alias("first"))


@query("mth2_cosine")
def _(s, d):
    pairs = Inputs(s, d).edges.select(F.col("source_id").alias("left_id"), F.col("target_id").alias("right_id")).distinct()
    known = Inputs(s, d).vectors.select("id")
    for side in ("left_id", "right_id"):
        pairs = pairs.join(known.withColumnRenamed("id", side), side, "left_semi")
    return V.scored(pairs, Inputs(s, d).vectors).select("left_id", "right_id", F.round("score", 6).alias("score"))


@query("jon1_similarity_pairs")
def _(s, d):
    return Inputs(s, d).pairs(0.25).select("left_id", "right_id", F.round("score", 6).alias("score"))


@query("jon2_active_closed_pairs")
def _(s, d):
    i = Inputs(s, d)
    return V.pairs_above(i.active_vectors, i.closed_vectors, 0.25).select("left_id", "right_id", F.round("score", 6).alias("score"))


@query("jon3_multi_view_pairs")
def _(s, d):
    v = Inputs(s, d).vectors
    half = v.select("id", F.lit("half").alias("channel"), V.normalize(F.slice("v", 1, 32)).alias("v")).filter(F.substring("id", -1, 1) < "7")
    views = v.select("id", F.lit("whole").alias("channel"), "v").unionByName(half)
    return V.multi_view_pairs(views, 0.4).select("left_id", "right_id", F.round("score", 6).alias("score"))


@query("jon4_scores")
def _(s, d):
    return _QUERIES["mth2_cosine"](s, d).groupBy().agg(F.count("*").alias("pairs"), F.round(F.avg("score"), 6).alias("mean_score"))


@query("flt3_scoped_pairs")
def _(s, d):
    near = F.substring("left_id", -1, 1).isin("3", "7") | F.substring("right_id", -1, 1).isin("3", "7")
    return Inputs(s, d).pairs(0.3).filter(near).select("left_id", "right_id")


@query("win1_top_ranks")
def _(s, d):
    v = Inputs(s, d).vectors
    return V.top_ranks(v, v, 5).select("query_id", "candidate_id", "rank")


@query("win2_rank_tables")
def _(s, d):
    i = Inputs(s, d)
    return qualify.rank_tables(i.active_vectors, i.closed_vectors, 5).select("kind", "query_id", "candidate_id", "rank")


@query("win3_mutual_neighbours")
def _(s, d):
    i = Inputs(s, d)
    return qualify.mutual(V.top_ranks(i.active_vectors, i.active_vectors, 5), 5)


@query("win4_target_rank")
def _(s, d):
    i = Inputs(s, d)
    pairs = i.edges.select(F.col("source_id").alias("query_id"), "target_id").filter("query_id <> target_id")
    ranks = V.pair_ranks(pairs, i.vectors, i.vectors)
    return ranks.select("query_id", F.col("target_id").alias("candidate_id"), F.col("rank").cast("int").alias("rank"))


@query("srt4_nearest_neighbours")
def _(s, d):
    v = R.table(s, d, "embeddings").transform(lambda e: V.unit_vectors(e, "vec_id", "embedding"))
    return V.top_ranks(v, v, 5).select("query_id", "candidate_id", "rank", F.round("score", 6).alias("score"))


@query("srt5_full_ranking")
def _(s, d):
    """Whole rankings, which only the records that are asked for get: every fiftieth."""
    v = Inputs(s, d).vectors
    asked = v.filter(F.substring("id", 5, 20).cast("long") % 50 == 0)
    return V.top_ranks(asked, v, 1 << 30).select("query_id", "candidate_id", "rank", F.round("score", 6).alias("score"))


@query("agg13_density")
def _(s, d):
    v = Inputs(s, d).active_vectors
    return V.score_sums(v, v).select("id", F.round("total", 6).alias("total"))


# --- relationships --------------------------------------------------------------


@query("agg1_relation_types")
def _(s, d):
    return Inputs(s, d).typed.groupBy("relationship_type").agg(F.count("*").alias("edges"))


@query("jon5_edge_endpoints")
def _(s, d):
    i = Inputs(s, d)
    return relations.edges_with_endpoints(i.edges, i.records)


@query("jon6_direct_relations")
def _(s, d):
    return relations.direct_relations(Inputs(s, d).edges)


@query("jon7_structural_context")
def _(s, d):
    i = Inputs(s, d)
    return relations.with_structure(i.pairs().select("left_id", "right_id"), i.records, i.edges)


@query("jon7_context_of_edges")
def _(s, d):
    i = Inputs(s, d)
    pairs = i.edges.select(F.least("source_id", "target_id").alias("left_id"), F.greatest("source_id", "target_id").alias("right_id")).distinct()
    return relations.with_structure(pairs, i.records, i.edges)


@query("jon16_pair_edges")
def _(s, d):
    i = Inputs(s, d)
    pairs = i.legacy.select(F.col("source_id").alias("left_id"), F.col("target_id").alias("right_id"))
    return relations.relations_between(i.typed, pairs)


@query("jon18_boundary")
def _(s, d):
    i = Inputs(s, d)
    return relations.boundary(i.edges, i.active).groupBy("boundary", "relationship_type").agg(F.count("*").alias("edges"))


@query("jon19_reviewable")
def _(s, d):
    i = Inputs(s, d)
    return relations.has_reviewable(i.edges, i.records, i.active)


def _funnel(s, d):
    i = Inputs(s, d)
    return relations.funnel_classes(i.edges, i.records, i.active, i.vectors, 0.1, 0.1, 0.05)


@query("agg6_dependency_funnel")
def _(s, d):
    return relations.dependency_funnel(_funnel(s, d)).drop("unaccounted")


@query("agg7_conservation")
def _(s, d):
    return relations.assert_conserved(relations.dependency_funnel(_funnel(s, d))).select("total_non_parent_typed", "unaccounted")


@query("agg12_relation_accounting")
def _(s, d):
    i = Inputs(s, d)
    return relations.relation_accounting(i.typed, i.active)


@query("set7_context_edges")
def _(s, d):
    i = Inputs(s, d)
    return relations.context_edges(i.edges, i.records)


@query("set8_canonical_relations")
def _(s, d):
    return relations.canonical_relations(Inputs(s, d).typed)


@query("win6_bounded_neighbours")
def _(s, d):
    i = Inputs(s, d)
    return relations.bounded_neighbours(relations.context_edges(i.edges, i.records), i.records)


# --- qualification and selection ------------------------------------------------


@query("agg4_document_frequencies")
def _(s, d):
    tokens = qualify.field_tokens(Inputs(s, d).records)
    rows = qualify.document_frequencies(tokens).withColumn("what", F.lit("token"))
    return rows.unionByName(qualify.document_frequencies(tokens, "phrases").withColumn("what", F.lit("phrase"))).groupBy("what", "df").agg(F.count("*").alias("terms"))


@query("agg5_rarity_limits")
def _(s, d):
    return qualify.rarity_limits(qualify.field_tokens(Inputs(s, d).records))


@query("win9_phrases")
def _(s, d):
    found = T.phrases(T.reciprocal_tokens(F.col("title")))
    return Inputs(s, d).records.select("id", F.explode(found).alias("phrase"))


@query("qlf3_local_evidence")
def _(s, d):
    i = Inputs(s, d)
    pairs = i.edges.select(F.col("source_id").alias("left_id"), F.col("target_id").alias("right_id")).distinct()
    return qualify.local_evidence(pairs, qualify.field_tokens(i.records))


@query("qlf4_substantive_body")
def _(s, d):
    return qualify.field_tokens(Inputs(s, d).records).groupBy("has_body").agg(F.count("*").alias("records"))


@query("qlf1_qualified")
def _(s, d):
    return Inputs(s, d).qualified().drop("issue_rank", "related_rank")


@query("qlf2_objectives")
def _(s, d):
    policy = CandidatePolicy(echo_threshold=0.35, overlap_threshold=0.40, objectives=frozenset({"overlap", "structure"}))
    return Inputs(s, d).qualified(policy).groupBy("kind", "lane", "admission_reason").agg(F.count("*").alias("candidates"))


@query("qlf5_scoped")
def _(s, d):
    i = Inputs(s, d)
    few = i.active.filter("n % 3 = 0").select("id")
    return i.qualified(POLICY, few).select("kind", "lane", "issue_id", "related_issue_id", "similarity", "admission_reason")


@query("win5_echo_alternatives")
def _(s, d):
    rows = Inputs(s, d).qualified().filter("kind = 'completed-work-echo'")
    return rows.groupBy("issue_id").agg(F.count_if(F.col("lane") != "dependency").alias("semantic"), F.count_if(F.col("lane") == "dependency").alias("dependency"))


@query("srt1_selection_order")
def _(s, d):
    from pyspark.sql import Window

    rows = Inputs(s, d).qualified()
    return rows.select("kind", "issue_id", "related_issue_id", F.row_number().over(Window.orderBy(*qualify.ranking_key())).alias("position"))


@query("srt2_report_order")
def _(s, d):
    from pyspark.sql import Window

    rows = Inputs(s, d).qualified()
    return rows.select("kind", "issue_id", "related_issue_id", F.row_number().over(Window.orderBy(*qualify.report_key())).alias("position"))


@query("prj6_compact_candidates")
def _(s, d):
    rows = Inputs(s, d).qualified()
    return rows.select(F.concat_ws("|", "kind", "issue_id", "related_issue_id").alias("candidate_id"), "lane", "similarity", "structural_corroboration")


def _decisions(s, d, policy: CandidatePolicy, inputs: Inputs | None = None, related_only: bool = False):
    i = inputs or Inputs(s, d)
    candidates = stage(i.qualified(policy, related_only=related_only), "candidates")
    return candidates, selection.select_candidates(candidates, policy)


TIGHT = CandidatePolicy(echo_threshold=0.3, overlap_threshold=0.3, max_total=60, max_per_issue=2, lane_reservations={"dependency": 10, "echo": 20, "overlap": 20})


#: Many echoes of few targets, so that target caps and backfills occur.
ECHOES = CandidatePolicy(echo_threshold=0.2, overlap_threshold=0.9, max_echoes=250, max_per_issue=10, max_echoes_per_target=1, max_echo_alternatives_per_active=5)


@query("sel1_selection")
def _(s, d):
    return _decisions(s, d, POLICY)[1]


@query("sel2_baseline_protection")
def _(s, d):
    i = Inputs(s, d)
    loose = CandidatePolicy(echo_threshold=0.3, overlap_threshold=0.3, max_total=60)
    requested, baseline = (stage(i.qualified(p), "candidates") for p in (loose, POLICY))
    return selection.select_candidates(requested, loose, baseline)


@query("sel3_reservations")
def _(s, d):
    return _decisions(s, d, TIGHT)[1]


@query("sel4_backfills")
def _(s, d):
    return _decisions(s, d, ECHOES)[1].filter("backfill_for > 0").select("issue_id", "related_issue_id", "backfill_for")


@query("sel5_capped_dependencies")
def _(s, d):
    """Without reservations the lane of relations is offered first, so no other candidate changes its decisions."""
    policy = CandidatePolicy(echo_threshold=0.3, overlap_threshold=0.3, exception_margin=1.0, max_dependencies=5)
    candidates, decisions = _decisions(s, d, policy, related_only=True)
    return selection.capped_dependencies(decisions, candidates)


@query("agg8_lane_metrics")
def _(s, d):
    return selection.lane_metrics(_decisions(s, d, TIGHT)[1])


@query("agg9_echo_hubs")
def _(s, d):
    return selection.echo_hubs(_decisions(s, d, ECHOES)[1])


@query("agg10_admission_reasons")
def _(s, d):
    return Inputs(s, d).qualified().groupBy("admission_reason").agg(F.count("*").alias("candidates"))


# --- code surfaces --------------------------------------------------------------


def _pointers(s: SparkSession, d: str) -> DataFrame:
    """Orders as work and the parts of their lines as paths; some are observed changes."""
    work = R.table(s, d, "orders").select(F.col("o_orderkey").alias("l_orderkey"))
    lines = R.table(s, d, "lineitem").join(work, "l_orderkey").select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_returnflag")
    path = F.format_string("src/m%d/f%d.py", F.floor(F.col("l_partkey") / 10), F.col("l_partkey"))
    pick = lambda *names: F.element_at(F.array(*map(F.lit, names)), (F.col("l_linenumber") % len(names) + 1).cast("int"))
    return lines.select(
        F.col("l_orderkey").alias("issue_id"), path.alias("path"),
        F.when(F.col("l_orderkey") % 5 == 0, surfaces.OBSERVED).otherwise("explicit-reference").alias("source"),
        F.when(F.col("l_orderkey") % 5 == 0, "observed-edit").otherwise(pick("likely-edit", "reference-only", "unknown")).alias("edit_intent"),
        F.when(F.col("l_orderkey") % 5 == 0, "observed-worktree").otherwise(pick("prose", "code-fence")).alias("context_kind"),
        pick("existing", "missing", "unavailable", "existing").alias("path_presence"),
        F.when(F.col("l_orderkey") % 5 == 0, F.concat(F.lit("r"), (F.col("l_orderkey") % 3).cast("string"))).alias("revision"),
        pick("title", "description").alias("source_field"),
        F.when(F.col("l_returnflag") == "A", F.format_string("run_%d", "l_suppkey")).alias("symbol"),
    ).distinct()


@query("agg2_pointer_counts")
def _(s, d):
    return surfaces.pointer_counts(_pointers(s, d))


@query("agg3_hubs")
def _(s, d):
    return surfaces.hubs(surfaces.surfaces(_pointers(s, d)), HUB_LIMIT)


@query("agg22_issue_counts")
def _(s, d):
    seen = F.col("source") == surfaces.OBSERVED
    return _pointers(s, d).agg(F.countDistinct(F.when(seen, F.col("issue_id"))).alias("observed"), F.countDistinct(F.when(~seen, F.col("issue_id"))).alias("explicit"))


@query("srt8_hub_order")
def _(s, d):
    from pyspark.sql import Window

    order = Window.orderBy(F.when(F.col("kind") == "path", 0).otherwise(1), F.desc("issue_count"), "surface")
    return surfaces.hubs(surfaces.surfaces(_pointers(s, d)), HUB_LIMIT).withColumn("position", F.row_number().over(order))


@query("jon8_shared_surfaces")
def _(s, d):
    return surfaces.shared_surfaces(surfaces.surfaces(_pointers(s, d)), HUB_LIMIT)


@query("col1_collisions")
def _(s, d):
    return _lines(surfaces.collisions(_pointers(s, d), HUB_LIMIT), "shared_paths", "shared_symbols", "shared_modules", "evidence_sources", "intent_source_fields")


def _guarded(s: SparkSession, d: str, scope: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Surfaces of all work, and what its pairs (in scope) share."""
    found = surfaces.signed(surfaces.surfaces(_pointers(s, d)))
    return found, surfaces.shared_evidence(found, HUB_LIMIT, scope=scope)


@query("col2_guard_counts")
def _(s, d):
    found, shared = _guarded(s, d)
    return s.range(1).select(*[F.lit(n).cast("long").alias(k) for k, n in surfaces.guard_counts(found, shared, HUB_LIMIT).items()])


@query("col2_hub_guard_sample")
def _(s, d):
    found, shared = _guarded(s, d)
    shared = stage(shared.select("issue_id", "related_issue_id"), "shared")
    return _lines(surfaces.hub_guard_sample(found, shared, HUB_LIMIT, 10), "suppressing_paths", "suppressing_modules")


@query("col3_scoped_collisions")
def _(s, d):
    """An incremental run: only pairs with work ordered since a day."""
    scope = R.table(s, d, "orders").filter("o_orderdate >= DATE '1998-01-01'").select(F.col("o_orderkey").alias("issue_id"))
    found, shared = _guarded(s, d, scope)
    shared = stage(shared, "shared")
    counts = surfaces.guard_counts(found, shared, HUB_LIMIT, scope)
    hits = surfaces.collisions(_pointers(s, d), HUB_LIMIT, scope=scope, shared=shared)
    return hits.agg(F.count("*").alias("collisions"), *[F.any_value(F.lit(n).cast("long")).alias(k) for k, n in counts.items()]).na.fill(0)


@query("set3_shared_evidence")
def _(s, d):
    shared = surfaces.shared_evidence(surfaces.surfaces(_pointers(s, d)), HUB_LIMIT)
    return _lines(shared, "shared_paths", "shared_symbols", "shared_modules").select("issue_id", "related_issue_id", "shared_paths", "shared_symbols", "shared_modules")


@query("srt6_collision_order")
def _(s, d):
    from pyspark.sql import Window

    rows = surfaces.collisions(_pointers(s, d), HUB_LIMIT)
    return rows.select("issue_id", "related_issue_id", F.row_number().over(Window.orderBy(*surfaces.collision_order())).alias("position"))


@query("flt6_paths")
def _(s, d):
    n = F.col("p_partkey")
    raw = F.element_at(
        F.array(*[F.format_string(f, n) for f in ("src/a%d.py", "`lib/x%d.TXT`", "docs/p%d/", "/abs/%d.py", "other/q%d/", "src/../%d.py", "node_modules/%d.js", "(src\\w%d.Go)", "C:/x%d.py", "./src/%d.py")]),
        (n % 10 + 1).cast("int"),
    )
    return R.table(s, d, "part").select("p_partkey", surfaces.normalize_path(raw).alias("path"), surfaces.normalize_git_path(raw).alias("git_path"))


@query("str10_path_mentions")
def _(s, d):
    n = F.col("doc_id")
    text = F.format_string("Update src/mod%d/file%d.py::run_%d and `README%d.md`, see https://x.example/src/a.py <!-- docs/b.md --> then review docs/parser%d/ or foo/bar", n % 7, n % 23, n % 3, n % 5, n % 4)
    whole = F.concat(F.coalesce("text", F.lit("")), F.lit("\n"), text)
    rows = R.table(s, d, "documents").select(n.alias("issue_id"), F.lit("title").alias("source_field"), whole.alias("text"))
    return surfaces.path_mentions(rows)


@query("str11_edit_intent")
def _(s, d):
    return R.table(s, d, "part").select("p_partkey", surfaces.edit_intent(F.concat_ws(" ", "p_name", F.element_at(F.array(*map(F.lit, ("fix it", "please review", "nothing", "prefix"))), (F.col("p_partkey") % 4 + 1).cast("int")))).alias("intent"))


@query("src11_changed_paths")
def _(s, d):
    rows = _pointers(s, d).select((F.col("issue_id") % 50).alias("worktree"), "path", "edit_intent")
    kinds = [rows.filter(f"edit_intent {test}") for test in ("IN ('observed-edit', 'likely-edit')", "= 'reference-only'", "= 'unknown'")]
    return surfaces.changed_paths(*kinds, guard=40).groupBy("worktree").agg(F.count("*").alias("paths"))


# --- graph, freshness, increments, evaluation -----------------------------------


def _graph(s, d):
    i = Inputs(s, d)
    return i, stage(i.pairs(0.34).select(F.col("left_id").alias("issue_id"), F.col("right_id").alias("related_issue_id")), "pairs")


@query("grf1_components")
def _(s, d):
    i, pairs = _graph(s, d)
    return graph.membership(pairs, i.active)


@query("grf3_batches")
def _(s, d):
    i, pairs = _graph(s, d)
    return graph.batches(graph.review_units(pairs, i.active, i.vectors, 5))


@query("grf4_balanced_batches")
def _(s, d):
    """The records of the queue, which the policy's caps bound, in batches of like ones."""
    admitted = _decisions(s, d, POLICY)[1].filter("decision = 'admitted'")
    ids = admitted.select(F.explode(F.array("issue_id", "related_issue_id")).alias("id")).distinct()
    return graph.balanced_batches(Inputs(s, d).vectors.join(ids, "id", "left_semi"))


@query("agg25_batch_diagnostics")
def _(s, d):
    i, pairs = _graph(s, d)
    return graph.diagnostics(stage(graph.review_units(pairs, i.active, i.vectors, 5), "units"), graph.active_links(pairs, i.active), 5)


@query("val1_validation")
def _(s, d):
    i, pairs = _graph(s, d)
    return graph.validate(stage(graph.review_units(pairs, i.active, i.vectors, 5), "units"), pairs, 5)


@query("jon14_no_signal")
def _(s, d):
    i = Inputs(s, d)
    ends = i.pairs(0.34).select(F.explode(F.array("left_id", "right_id")).alias("id"))
    return i.active.select("id").join(ends, "id", "left_anti")


@query("flt4_orphans")
def _(s, d):
    i = Inputs(s, d)
    rows = relations.with_structure(i.pairs(), i.records, i.edges).filter(F.col("structural_context") == "none recorded")
    return rows.orderBy(F.desc(F.round("score", 6)), "left_id", "right_id").limit(20).select("left_id", "right_id", F.round("score", 6).alias("score"))


def _pool(s, d):
    i = Inputs(s, d)
    rows = numbered(stage(i.qualified(), "candidates"), qualify.ranking_key())
    return i, rows.withColumn("position", F.col("position").cast("int"))


@query("frs1_freshness")
def _(s, d):
    i, pool = _pool(s, d)
    rows = freshness.classify(pool, i.records, i.edges, i.active)
    return _lines(rows, "evidence_codes").select("kind", "issue_id", "related_issue_id", "likely_action", "review_tier", "evidence_codes")


@query("agg23_freshness_summary")
def _(s, d):
    i, pool = _pool(s, d)
    return freshness.summary(freshness.classify(pool, i.records, i.edges, i.active))


@query("win10_freshness_queue")
def _(s, d):
    i, pool = _pool(s, d)
    return freshness.queue(freshness.classify(pool, i.records, i.edges, i.active), 20).select("kind", "issue_id", "related_issue_id", "position", "freshness_position")


@query("jon15_consumers")
def _(s, d):
    i = Inputs(s, d)
    pairs = i.edges.select(F.col("source_id").alias("issue_id"), F.col("target_id").alias("related_issue_id")).distinct()
    return freshness.third_party_consumer(pairs, i.edges, i.active)


@query("frs2_direct_codes")
def _(s, d):
    i = Inputs(s, d)
    pairs = i.edges.select(F.col("source_id").alias("issue_id"), F.col("target_id").alias("related_issue_id")).distinct()
    return freshness.direct_codes(pairs, i.edges, i.records).withColumn("direct", F.array_join(F.array_sort("direct"), ","))


@query("frs3_lifecycle")
def _(s, d):
    i = Inputs(s, d)
    rows = relations.edges_with_endpoints(i.edges, i.records)
    return rows.groupBy(freshness.lifecycle(F.col("source_status"), F.col("target_status")).alias("lifecycle")).agg(F.count("*").alias("pairs"))


COLUMNS = ["id", "title", "status", "priority", "parent_id"]


def _snapshots(s, d):
    rows = Inputs(s, d).records
    now = rows.filter("n % 17 <> 0").withColumn("status", F.when(F.col("n") % 10 == 0, "resolved").otherwise(F.col("status")))
    return now, rows.filter("n % 23 <> 0")


@query("jon10_checkpoint_states")
def _(s, d):
    now, before = _snapshots(s, d)
    return incremental.compare(incremental.checkpoint(now, COLUMNS), incremental.checkpoint(before, COLUMNS))


@query("jon10_remembered_states")
def _(s, d):
    """Two snapshots through the stream that remembers fingerprints, one run after the other."""
    now, before = _snapshots(s, d)
    arriving, out, state = (shared_path(s, x) for x in ("arriving", "remembered", "stream-state"))
    kept = s.conf.get(scope.ROCKSDB[0])
    s.conf.set(*scope.ROCKSDB)
    try:
        for day, rows in enumerate((before, now), 1):
            taken = rows.select("id", *[c for c in COLUMNS if c != "id"], F.lit(f"2024-01-0{day}").cast("timestamp").alias("taken_at"))
            taken.write.mode("append").parquet(arriving)
            run = scope.follow_snapshots(s, arriving, taken.schema, COLUMNS, out, state)
            run.awaitTermination()
    finally:
        s.conf.set(scope.ROCKSDB[0], kept)
    return s.read.parquet(out).select("id", F.dayofmonth(F.timestamp_millis("snapshot")).alias("day"), "state")


@query("jon11_cached_runs")
def _(s, d):
    """Three runs over one cache: even records, all, and all again."""
    texts, root = Inputs(s, d).records.select("n", "id", F.col("title").alias("text")), shared_path(s, "vector-cache")
    model, rows = vector_cache.Model("hashing", "1", 16), []
    for run, own in enumerate((texts.filter("n % 2 = 0"), texts, texts), 1):
        got = vector_cache.cached_vectors(own.select("id", "text"), lambda missing: V.hashing_vectors(missing, 16), model, root)
        rows.append(got.vectors.agg(F.lit(run).alias("run"), F.lit(got.hits).cast("long").alias("hits"), F.lit(got.encoded).cast("long").alias("encoded"), F.count("v").alias("vectors")))
    return rows[0].unionByName(rows[1]).unionByName(rows[2])


@query("jon9_divergence")
def _(s, d):
    return incremental.divergence(*_snapshots(s, d), COLUMNS)


@query("agg18_state_digest")
def _(s, d):
    rows = Inputs(s, d).records
    return incremental.state_digest(rows, ["status", "priority"])


@query("agg19_fingerprints")
def _(s, d):
    return incremental.checkpoint(Inputs(s, d).records, COLUMNS)


@query("agg20_content_keys")
def _(s, d):
    return Inputs(s, d).records.select("id", incremental.content_key("hashing", "1", F.col("title")).alias("key"))


@query("set4_deleted")
def _(s, d):
    now, before = _snapshots(s, d)
    return before.select("id").join(now.select("id"), "id", "left_anti")


@query("jon11_cache")
def _(s, d):
    rows = Inputs(s, d).records.select("id", incremental.content_key("m", "1", F.col("title")).alias("key"))
    cache = rows.filter("id < 'doc-000100'").select("key", F.lit(1).alias("cached"))
    found = incremental.with_cache(rows, cache)
    return found.agg(F.count("cached").alias("hits"), F.countDistinct(F.when(F.col("cached").isNull(), F.col("key"))).alias("misses"))


def _judged(s, d):
    q = R.table(s, d, "labels").select(R.record_id(F.col("doc_id")).alias("id"), "quality", F.lead("doc_id").over(_by_doc()).alias("next"))
    pairs = q.select(F.col("id").alias("left_id"), R.record_id(F.col("next")).alias("right_id"), "quality")
    rated = pairs.join(q.select(F.col("id").alias("right_id"), F.col("quality").alias("q2")), "right_id").select("left_id", "right_id", (F.col("quality") + F.col("q2")).alias("rating"))
    known = Inputs(s, d).vectors.select("id")
    for side in ("left_id", "right_id"):
        rated = rated.join(known.withColumnRenamed("id", side), side, "left_semi")
    return rated


def _by_doc():
    from pyspark.sql import Window

    return Window.orderBy("doc_id")


@query("agg14_budget_metrics")
def _(s, d):
    return evaluate.budget_metrics(V.scored(_judged(s, d), Inputs(s, d).vectors), 20, 0.1)


@query("agg14_recall_at_5")
def _(s, d):
    v = Inputs(s, d).vectors
    return evaluate.recall_at(V.top_ranks(v, v, 5), _judged(s, d), 5)


@query("agg15_rating_means")
def _(s, d):
    return evaluate.rating_means(V.scored(_judged(s, d), Inputs(s, d).vectors))


@query("agg24_tf_idf")
def _(s, d):
    rows = R.table(s, d, "benchmark").select(F.col("item_id").alias("id"), F.explode(F.regexp_extract_all(F.lower("text"), F.lit("([a-z0-9]+)"), 1)).alias("token"))
    return evaluate.term_weights(rows).select("id", "token", F.round("weight", 6).alias("weight"))


@query("mth5_sparse_scores")
def _(s, d):
    b = R.table(s, d, "benchmark")
    rows = b.select(F.col("item_id").alias("id"), F.explode(F.regexp_extract_all(F.lower("text"), F.lit("([a-z0-9]+)"), 1)).alias("token"))
    pairs = b.select(F.col("item_id").alias("left_id"), (F.col("item_id") + 1).alias("right_id"))
    return evaluate.sparse_scores(evaluate.term_weights(rows), pairs).select("left_id", "right_id", F.round("score", 6).alias("score"))


@query("mth4_dice")
def _(s, d):
    i = Inputs(s, d)
    own = i.records.select("id", T.explain_tokens(F.col("title"), STOP_WORDS).alias("tokens"))
    pairs = i.edges.select("source_id", "target_id").distinct()
    rows = pairs.join(own.select(F.col("id").alias("source_id"), F.col("tokens").alias("a")), "source_id").join(own.select(F.col("id").alias("target_id"), F.col("tokens").alias("b")), "target_id")
    return rows.select("source_id", "target_id", F.round(T.dice(F.col("a"), F.col("b")), 3).alias("dice"))


@query("win7_stratified_sample")
def _(s, d):
    from pyspark.sql import Window

    rows = Inputs(s, d).pairs(0.3).withColumn("candidate_id", F.concat_ws("|", "left_id", "right_id"))
    ranked = rows.select("candidate_id", F.when(F.substring("left_id", -1, 1) < "5", "echo").otherwise("overlap").alias("lane"), F.row_number().over(Window.orderBy(F.desc(F.round("score", 6)), "candidate_id")).alias("rank"))
    return evaluate.stratified_sample(ranked, "seed", (20, 50, 100), 5)


@query("agg26_export_summary")
def _(s, d):
    closed = R.is_closed(F.col("status"))
    return Inputs(s, d).records.agg(F.count("*").alias("issues"), F.count_if(~closed).alias("active"), F.count_if(closed).alias("closed"))


# --- explanation, scalars, sets -------------------------------------------------


@query("exp2_patterns")
def _(s, d):
    i = Inputs(s, d)
    rows = explain.explain(i.qualified().select("kind", "lane", "issue_id", "related_issue_id", "similarity", "structural_context"), i.records, STOP_WORDS)
    return rows.select("kind", "issue_id", "related_issue_id", "pattern", "objective", F.array_join("evidence_fields", ",").alias("evidence_fields"), "title_score", "description_score")


@query("mth3_hashing_vectors")
def _(s, d):
    """Signed hashing vectors of the benchmark's texts; BLAKE2b is beyond SQL, so tests check it."""
    v = V.hashing_vectors(R.table(s, d, "benchmark").select(F.col("item_id").alias("id"), "text"))
    rows = v.select(F.col("id").alias("item_id"), F.posexplode("v").alias("bucket", "value")).filter("value <> 0")
    return rows.select("item_id", "bucket", F.round("value", 6).alias("value"))


@query("mth6_identifier_score")
def _(s, d):
    c = R.table(s, d, "customer").select("c_custkey", F.concat_ws(" ", "c_mktsegment", F.concat(F.lit("AB-"), (F.col("c_custkey") % 20 + 10))).alias("t"))
    other = c.select((F.col("c_custkey") - 20).alias("c_custkey"), F.col("t").alias("u"))
    return c.join(other, "c_custkey").select("c_custkey", T.identifier_score(F.col("t"), F.col("u")).alias("score"))


@query("mth7_batch_capacities")
def _(s, d):
    n, t = F.col("p_partkey"), (F.col("p_size") % 9 + 1).cast("bigint")
    count = F.least(n, F.greatest(F.lit(1), F.floor((n + F.floor(t / 2)) / t)))
    rows = R.table(s, d, "part").filter("p_partkey > 0").select("p_partkey", count.cast("bigint").alias("batches"))
    return rows.withColumns({"capacity": F.floor(F.col("p_partkey") / F.col("batches")), "larger": F.col("p_partkey") % F.col("batches")})


@query("mth8_lane_reservations")
def _(s, d):
    caps = CandidatePolicy().lane_caps
    rows = [(n, *selection.lane_reservations(n, caps).values()) for n in range(1, 301)]
    return s.createDataFrame(rows, "queue int, dependency int, echo int, overlap int")


@query("str4_words")
def _(s, d):
    rows = R.table(s, d, "conversations").select("conv_id", "turn", T.word_tokens(F.col("text")).alias("w"))
    return rows.select("conv_id", "turn", F.size("w").alias("words"), F.md5(F.array_join("w", " ")).alias("digest"))


@query("str8_plain_titles")
def _(s, d):
    return Inputs(s, d).records.select("id", T.plain_title(F.col("title")).alias("title"))


@query("str16_label_types")
def _(s, d):
    n = F.col("p_partkey")
    pick = lambda k, *names: F.element_at(F.array(*map(F.lit, names)), (k % len(names) + 1).cast("int"))
    labels = F.array(pick(n, "Bug", "regression test", "Feature request", "enhancement", "docs"), pick(F.col("p_size"), "P0", "priority: high", "low priority", "p3", "Blocker", "someday", "p1"))
    kind, urgency = host_pages.label_rules(labels)
    return R.table(s, d, "part").select("p_partkey", kind.alias("issue_type"), urgency.alias("priority"))


@query("str18_mappings")
def _(s, d):
    text = F.concat(F.col("n_nationkey"), F.lit(" = /w/"), F.col("n_name"), F.lit("=x"))
    return surfaces.mappings(R.table(s, d, "nation").select(text.alias("value"))).select(F.col("issue_id").alias("id"), "path")


@query("arr4_ordered_distinct")
def _(s, d):
    words = F.split(F.lower("text"), "[ \n]")
    return R.table(s, d, "benchmark").select("item_id", F.array_join(F.array_distinct(words), " ").alias("words"))


@query("agg16_pair_quality")
def _(s, d):
    i = Inputs(s, d)
    partners = i.edges.filter("relationship_type = 'blocks'").groupBy(F.col("source_id").alias("left_id")).agg(F.min("target_id").alias("right_id"))
    known = partners
    for side in ("left_id", "right_id"):
        known = known.join(i.vectors.select(F.col("id").alias(side)), side, "left_semi")
    few = i.vectors.join(known.select(F.col("left_id").alias("id")), "id", "left_semi")
    return evaluate.pair_quality(V.top_ranks(few, i.vectors, 2), V.scored(known, i.vectors))


@query("agg17_medians")
def _(s, d):
    return R.table(s, d, "events").groupBy("event_type").agg(F.round(F.median("value"), 6).alias("median"))


@query("set3_shared_modules")
def _(s, d):
    found = surfaces.surfaces(_pointers(s, d)).filter("kind = 'module'")
    by = found.groupBy("issue_id").agg(F.array_sort(F.collect_set("surface")).alias("m"))
    other = by.select((F.col("issue_id") - 1).alias("issue_id"), F.col("m").alias("n"))
    return by.join(other, "issue_id").select("issue_id", F.array_join(F.array_intersect("m", "n"), ",").alias("shared"))


@query("set5_additions")
def _(s, d):
    i = Inputs(s, d)
    keys = ["kind", "issue_id", "related_issue_id"]
    loose = CandidatePolicy(echo_threshold=0.32, overlap_threshold=0.36)
    rows = i.qualified(loose)
    return rows.join(i.qualified().select(*keys), keys, "left_anti").groupBy("kind", "lane").agg(F.count("*").alias("candidates"))


@query("srt9_queue_receipt")
def _(s, d):
    rows = Inputs(s, d).pairs(0.34)
    n = rows.agg(F.count("*").alias("available"))
    return n.select("available", F.least("available", F.lit(20)).alias("queued"), F.when(F.col("available") > 20, "budget-reached").otherwise("source-exhausted").alias("reason"))


@query("srt11_hub_sample")
def _(s, d):
    found = surfaces.surfaces(_pointers(s, d))
    hub = found.join(surfaces.hubs(found, HUB_LIMIT).select("kind", "surface"), ["kind", "surface"], "left_semi").filter("kind = 'path' AND NOT observed")
    first = hub.groupBy("surface").agg(F.min("issue_id").alias("issue_id"))
    second = hub.join(first.withColumnRenamed("issue_id", "first"), "surface").filter("issue_id > first").groupBy("surface").agg(F.min("issue_id").alias("related_issue_id"))
    return first.join(second, "surface", "left").select("surface", "issue_id", "related_issue_id").orderBy("issue_id", "surface").limit(10)


@query("src7_team_lookup")
def _(s, d):
    """The one team whose id, key or name is the asked one in any case."""
    n = R.table(s, d, "nation")
    node = F.to_json(F.struct(F.concat(F.lit("team-"), "n_nationkey").alias("id"), F.substring("n_name", 1, 4).alias("key"), F.initcap("n_name").alias("name")))
    wanted = n.agg(F.min_by("n_name", F.abs(F.col("n_nationkey") - 3))).first()[0]
    found, _ = host_pages.pick_team(n.select(node.alias("node")), f" {wanted.lower()} ")
    return n.filter(F.concat(F.lit("team-"), "n_nationkey") == found).select("n_nationkey", "n_name")


@query("src16_judgments")
def _(s, d):
    return evaluate.judgment_counts(_judged(s, d), Inputs(s, d).records)


@query("src10_worktrees")
def _(s, d):
    n = F.col("n_nationkey")
    branch = F.when(n % 4 == 0, F.lit("detached")).otherwise(F.concat(F.lit("branch refs/heads/fix-"), n))
    blocks = R.table(s, d, "nation").select(F.concat(F.lit("worktree /w/"), F.lower("n_name"), F.lit("\nHEAD h"), n, F.lit("\n"), branch).alias("value"))
    return surfaces.worktrees(blocks)


@query("src14_cache_read")
def _(s, d):
    """Cached vectors that are of the wanted size and usable; anything else is a miss."""
    cache = R.table(s, d, "embeddings").select("vec_id", F.when(F.col("vec_id") % 10 == 0, F.slice("embedding", 1, 8)).when(F.col("vec_id") % 11 == 0, F.transform("embedding", lambda x: x * 0)).otherwise(F.col("embedding")).alias("v"))
    fine = (F.size("v") == 64) & V.normalize(F.col("v")).isNotNull()
    return cache.groupBy(fine.alias("hit")).agg(F.count("*").alias("vectors"))


@query("jon13_batch_evidence")
def _(s, d):
    """For each batch of ids, the candidate pairs that touch one of its members."""
    i = Inputs(s, d)
    members = i.active.select("id", F.floor(F.col("n") / 100).alias("batch"))
    pairs = i.pairs(0.3).select("left_id", "right_id")
    ends = pairs.select("left_id", "right_id", F.explode(F.array("left_id", "right_id")).alias("id"))
    return ends.join(members, "id").select("batch", "left_id", "right_id").distinct().groupBy("batch").agg(F.count("*").alias("pairs"))


@query("set6_displaced")
def _(s, d):
    """Identities that looser thresholds bring in, push out, or leave in the queue."""
    keys = ["kind", "issue_id", "related_issue_id"]
    i = Inputs(s, d)
    strict = _decisions(s, d, POLICY, i)[1].filter("decision = 'admitted'").select(*keys, F.lit(1).alias("a"))
    loose = _decisions(s, d, TIGHT, i)[1].filter("decision = 'admitted'").select(*keys, F.lit(1).alias("b"))
    change = F.when(F.col("a").isNull(), "introduced").when(F.col("b").isNull(), "displaced").otherwise("kept")
    return strict.join(loose, keys, "full").select(*keys, change.alias("change"))


@query("set9_warnings")
def _(s, d):
    c = R.table(s, d, "conversations")
    a = F.collect_set(F.when(F.col("turn") < 2, F.col("role")))
    b = F.collect_set(F.when(F.col("turn") >= 2, F.col("role")))
    return c.groupBy("conv_id").agg(F.array_join(F.array_sort(F.array_union(a, b)), ",").alias("roles"))


@query("prj4_state_mapping")
def _(s, d):
    """Orders as an issue host's nodes, read by its record parser."""
    state = F.col("o_orderstatus")
    kind = F.when(state == "F", "Completed").when(state == "P", "started").when(state == "O", "backlog").otherwise(state)
    rank = F.substring("o_orderpriority", 1, 1).cast("int") - 1
    day = F.date_format("o_orderdate", "yyyy-MM-dd'T'00:00:00'Z'")
    node = F.struct(F.concat(F.lit("ENG-"), "o_orderkey").alias("identifier"), F.col("o_orderpriority").alias("title"), F.struct(kind.alias("type")).alias("state"), rank.alias("priority"), day.alias("updatedAt"))
    records = host_pages.parse_issues(R.table(s, d, "orders").select(F.to_json(node).alias("node")))
    return records.groupBy("status", "priority").agg(F.count("*").alias("records"))


@query("srt10_bounded_evidence")
def _(s, d):
    found = surfaces.surfaces(_pointers(s, d)).filter("kind = 'path'")
    return found.groupBy("issue_id").agg(F.array_join(F.slice(F.array_sort(F.collect_set("surface")), 1, 3), ",").alias("paths"))


@query("arr5_connections")
def _(s, d):
    """Nested pages of nodes, packed to JSON and taken apart again."""
    c = R.table(s, d, "conversations")
    node = F.struct(F.col("turn").alias("id"), F.struct(F.col("role").alias("name")).alias("state"))
    page = F.to_json(F.struct(F.struct(F.array_sort(F.collect_list(node)).alias("nodes")).alias("issues")))
    kind = "struct<issues:struct<nodes:array<struct<id:bigint,state:struct<name:string>>>>>"
    rows = c.groupBy("conv_id").agg(page.alias("p")).select("conv_id", F.explode(F.from_json("p", kind)["issues"]["nodes"]).alias("n"))
    return rows.select("conv_id", "n.id", "n.state.name")


def queries() -> dict[str, Query]:
    from quillon import catalog_review

    return {**_QUERIES, **catalog_review.queries()}


def oracle_sql() -> dict[str, str]:
    from quillon import catalog_review, oracles_queue

    return {**oracles.queries(), **oracles_queue.queries(), **catalog_review.oracle_sql()}
