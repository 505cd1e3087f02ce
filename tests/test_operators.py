"""Small cases of operators whose results SQL does not check."""

import hashlib
import json
import re
import time
from pathlib import Path

import numpy as np
import pytest

from quillon import catalog
from quillon.functions import text as T
from quillon.model import CandidatePolicy
from quillon.operators import evaluate, freshness, graph, incremental, relations, selection, surfaces
from quillon.operators import vectors as V
from quillon.plans import ranked_review, shadow
from pyspark.sql import functions as F


def vectors(spark, rows):
    return V.unit_vectors(spark.createDataFrame(rows, "id string, e array<double>"), "id", "e")


def test_ranks_break_ties_by_id(spark):
    v = vectors(spark, [("Q", [1.0, 0.0]), ("B", [1.0, 1.0]), ("A", [1.0, 1.0]), ("C", [0.0, 1.0]), ("N", [0.0, 0.0])])
    for block in (2048, 2):
        rows = V.top_ranks(v, v, 2, block).collect()
        got = {q: [r.candidate_id for r in sorted(rows, key=lambda r: r.rank) if r.query_id == q] for q in "QA"}
        assert got == {"Q": ["A", "B"], "A": ["B", "C"]}


def test_target_ranks_of_all_edges(spark, sf_dir):
    i = catalog.Inputs(spark, sf_dir)
    own = {r.id: np.array(r.v) for r in i.vectors.collect()}
    pairs = {(r.source_id, r.target_id) for r in i.edges.collect() if r.source_id != r.target_id and r.source_id in own and r.target_id in own}
    place = lambda q: {c: k + 1 for k, c in enumerate(sorted(own.keys() - {q}, key=lambda c: (-round(float(own[q] @ own[c]), 12), c)))}
    got = {(r.query_id, r.candidate_id): r["rank"] for r in catalog.queries()["win4_target_rank"](spark, sf_dir).collect()}
    assert len(pairs) > 50 and got == {(q, t): place(q)[t] for q, t in pairs}


def test_pairs_in_blocks_equal_all_pairs(spark):
    rng = np.random.default_rng(0)
    x = rng.standard_normal((60, 8))
    v = vectors(spark, [(f"{k:03d}", row.tolist()) for k, row in enumerate(x)])
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    want = {(f"{i:03d}", f"{j:03d}") for i in range(60) for j in range(i + 1, 60) if u[i] @ u[j] >= 0.3}
    for block in (7, 100):
        assert {(r.left_id, r.right_id) for r in V.pairs_above(v, None, 0.3, block).collect()} == want
    with pytest.raises(Exception, match="missing vector"):
        V.scored(spark.createDataFrame([("000", "zzz")], "left_id string, right_id string"), v).collect()


def test_peel_keeps_units_connected():
    members = [f"n{k}" for k in range(9)]
    links = {frozenset((f"n{k}", f"n{k + 1}")) for k in range(8)}
    units = graph.peel(members, links, lambda a, b: 0.0, 4)
    assert sorted(sum(units, [])) == members and all(len(u) <= 4 for u in units)
    assert units == [["n0", "n1", "n2", "n3"], ["n4", "n5", "n6", "n7"], ["n8"]]


def test_peel_of_numbers_is_the_rule_and_takes_large_components():
    """The units of the rule on many small graphs, and a component of 20,000 nodes in seconds."""

    def table(count, links):
        both = np.array(sorted({(a, b) for x, y in links for a, b in ((x, y), (y, x)) if a != b}), np.int64).reshape(-1, 2)
        return np.searchsorted(both[:, 0], np.arange(count + 1)), both[:, 1]

    rng = np.random.default_rng(5)
    for _ in range(150):
        count = int(rng.integers(2, 40))
        links = {(k, int(rng.integers(0, k))) for k in range(1, count)} | {tuple(x) for x in rng.integers(0, count, (int(rng.integers(0, 30)), 2)).tolist()}
        v = rng.standard_normal((count, 4))
        size = int(rng.integers(2, 7))
        want = graph.peel(list(range(count)), {frozenset(x) for x in links if x[0] != x[1]}, lambda a, b, v=v: float(v[a] @ v[b]), size)
        assert graph.peel_numbers(*table(count, links), v, size) == want
    links = {(k, int(x)) for k in range(1, 20_000) for x in rng.integers(0, k, 10)}
    begun = time.process_time()
    units = graph.peel_numbers(*table(20_000, links), rng.standard_normal((20_000, 4)), 5)
    assert sorted(sum(units, [])) == list(range(20_000)) and time.process_time() - begun < 60


def test_balanced_batches_cover_all(spark):
    rng = np.random.default_rng(1)
    v = vectors(spark, [(f"{k:02d}", rng.standard_normal(4).tolist()) for k in range(23)])
    rows = graph.balanced_batches(v, 5).collect()
    sizes = np.bincount([r.batch for r in rows])[1:]
    assert len({r.id for r in rows}) == 23 and sizes.max() - sizes.min() <= 1 and len(sizes) == 5


def test_every_active_record_is_in_a_batch(spark, sf_dir):
    v = catalog.Inputs(spark, sf_dir).active_vectors.unionByName(catalog.Inputs(spark, sf_dir).active_vectors.select(F.concat(F.lit("z"), "id").alias("id"), "v"))
    own = {r.id: np.array(r.v) for r in v.collect()}
    left, want, target = sorted(own), [], 9
    count = max(1, (len(left) + target // 2) // target)
    n = len(left)
    for k in range(count):
        mean = {a: round(sum(float(own[a] @ own[b]) for b in left if b != a), 9) for a in left}
        seed = min(left, key=lambda a: (-mean[a], a))
        rest = sorted((a for a in left if a != seed), key=lambda a: (-round(float(own[seed] @ own[a]), 12), a))
        members = [seed, *rest[: n // count + (k < n % count) - 1]]
        want += [(k + 1, p + 1, a) for p, a in enumerate(members)]
        left = [a for a in left if a not in members]
    assert sorted(map(tuple, graph.balanced_batches(v).collect())) == want


def test_grf4_has_all_records_of_the_queue(spark):
    d, run = "/root/testdata/sf0.01", catalog.queries()
    queue = run["sel1_selection"](spark, d).filter("decision = 'admitted'").collect()
    want = sorted({end for r in queue for end in (r.issue_id, r.related_issue_id)})
    rows = run["grf4_balanced_batches"](spark, d).collect()
    sizes = np.bincount([r.batch for r in rows])[1:]
    assert sorted(r.id for r in rows) == want and sizes.max() - sizes.min() <= 1 and max(want) > "doc-000200"


def test_text_forms(spark):
    row = spark.createDataFrame([("a \r\nb\t\r c\n\n", "getHTTPValue fooBar api", "Ünïcode_Straße - ﬁne²!")], "t string, u string, w string").select(
        T.normalize_text(F.col("t")).alias("n"), T.reciprocal_tokens(F.col("u")).alias("k"), T.plain_title(F.col("w")).alias("p"), T.word_tokens(F.col("w")).alias("q")
    ).first()
    assert (row.n, row.k, row.p) == ("a\nb\n c", ["get", "httpvalue", "foo", "bar"], "ünïcode strasse fine2")
    assert row.q == ["ünïcode_strasse", "-", "fine²"]
    few = spark.createDataFrame([("It's A-1_b",), ("",), (None,), ("ÀΣ",)], "w string").select(T.word_tokens(F.col("w")).alias("q"), T.plain_title(F.col("w")).alias("p")).collect()
    assert [(r.q, r.p) for r in few] == [(["it's", "a-1_b"], "it s a 1 b"), ([""], ""), ([""], ""), (["àσ"], "àσ")]


def test_fields_keep_sixteen_thousand_characters(spark, tmp_path):
    text = "x" * 17_000
    spark.createDataFrame([(1, text, "en", "s")], "doc_id long, text string, lang string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    row = spark.createDataFrame([("t", text, "", "", "")], "title string, description string, acceptance_criteria string, design string, notes string")
    assert row.select(T.canonical_text().alias("c")).first().c.count("x") == 16_000
    got = catalog.queries()["str1_normalized_text"](spark, str(tmp_path)).first().digest
    assert got == hashlib.md5(text[:16_000].encode()).hexdigest()


def test_path_mentions(spark):
    text = "Fix `README.md` and `src/parser/dependencies.py::parse_dependency` but not foo/bar, https://x.io/src/a.py, releases/1.2.3; update docs/parser/ <!-- lib/z.py -->"
    rows = surfaces.path_mentions(spark.createDataFrame([("i", "title", text)], "issue_id string, source_field string, text string")).collect()
    assert {(r.path, r.symbol) for r in rows} == {("README.md", None), ("docs/parser/", None), ("src/parser/dependencies.py", "parse_dependency")}


def test_worktree_blocks(spark):
    block = "worktree /a/b\nHEAD abc\nbranch refs/heads/fix-1\n"
    row = surfaces.worktrees(spark.createDataFrame([(block,), ("worktree /c\nHEAD d\ndetached",)], "value string")).orderBy("path").collect()
    assert [tuple(r) for r in row] == [("/a/b", "abc", "fix-1"), ("/c", "d", None)]


def test_time_stamps(spark):
    texts = ["2024-01-01T10:00:00.5+02:00", "2024-01-01T10:00:00Z", "2024-01-01T10:00:00", "junk", None]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select(incremental.utc_text(F.col("t")).alias("u"), F.date_format(incremental.nearest_second(F.col("t")), "HH:mm:ss").alias("s")).collect()
    assert [r.u for r in rows] == ["2024-01-01T08:00:00Z", "2024-01-01T10:00:00Z", None, None, None]
    assert rows[0].s == "08:00:01"


def test_state_digest_ignores_order(spark):
    rows = [(f"r{k}", "OPEN" if k % 2 else "closed", "2024-01-01T00:00:00Z") for k in range(50)]
    df = spark.createDataFrame(rows, "id string, status string, updated_at string")
    other = spark.createDataFrame([(i, s.lower(), t.replace("Z", "+00:00")) for i, s, t in rows[::-1]], df.schema).repartition(5)
    one, two = (incremental.state_digest(d, ["status"]).first() for d in (df, other))
    assert one == two
    assert incremental.state_digest(df.filter("id <> 'r7'"), ["status"]).first().digest != one.digest


def test_reference_cue(spark):
    rows = [
        ("This is a follow-up of doc-000007, as agreed", True),
        ("doc-000007 is near", False),
        ("depends on xdoc-000007", False),
        ("x" * 200 + " after " + "y" * 200 + " doc-000007", False),
        ("doc-000007 is blocked by another", True),
        ("A split from: doc-000007.", True),
        ("decision from doc-000007 and", True),
        ("split of doc-000007", False),
        ("Found by a re-review of (DOC-000007)", True),
        ("doc-000007 - rereviewed by them", True),
        ("doc-000007: removed the flag, but kept the rest", True),
        ("doc-000007 removed the flag", False),
        ("from doc-000007, adversarial review", True),
        ("of doc-000007, adversarial review", False),
        ("doc-000007.1 after", False),
        ("doc-000007. After that", True),
        ("builds doc-000007 on", False),
        ("doc-000007 x " + "y" * 100 + " doc-000007 follow-up", True),
        ("z" * 4090 + " doc-000007 after", False),
        ("", False),
        (None, False),
    ]
    df = spark.createDataFrame([(t,) for t, _ in rows], "t string").repartition(1)
    got = df.select(freshness.reference_with_cue(F.col("t"), F.lit("doc-000007")).alias("c")).collect()
    assert [r.c for r in got] == [want for _, want in rows]


def test_unknown_code_fails(spark):
    df = spark.createDataFrame([(["direct-blocks", None, "direct-parent-child"],), (["odd"],)], "c array<string>")
    assert df.limit(1).select(freshness.ordered_codes(F.col("c")).alias("c")).first().c == ["direct-parent-child", "direct-blocks"]
    with pytest.raises(Exception, match="unknown freshness evidence code: odd"):
        df.select(freshness.ordered_codes(F.col("c")).alias("c")).collect()


def test_pair_quality_needs_two_ranks_only(spark):
    ranks = spark.createDataFrame([("a", "b", 0.9, 1), ("a", "c", 0.5, 2), ("d", "e", 0.7, 1), ("d", "g", 0.6, 2)], "query_id string, candidate_id string, score double, rank int")
    partners = spark.createDataFrame([("a", "b", 0.9), ("d", "f", 0.1)], "left_id string, right_id string, score double")
    assert tuple(evaluate.pair_quality(ranks, partners).first()) == (0.5, -0.1)


def test_judgments_are_checked(spark):
    records = spark.createDataFrame([("a",), ("b",)], "id string")
    fine = spark.createDataFrame([("a", "b", 2), ("b", "a", 0)], "left_id string, right_id string, rating int")
    assert {(r.rating, r.pairs, r.missing_endpoints) for r in evaluate.judgment_counts(fine, records).collect()} == {(2, 1, 0), (0, 1, 0)}
    for row, told in ((("a", "x", 1), "no two known records"), (("a", "a", 1), "no two known records"), (("a", "b", 3), "not 0, 1 or 2"), (("a", "b", None), "not 0, 1 or 2")):
        with pytest.raises(Exception, match=told):
            evaluate.check_judgments(spark.createDataFrame([row], fine.schema), records).collect()


def test_mappings(spark):
    rows = surfaces.mappings(spark.createDataFrame([(" a = /w/x=1 ",), ("b=/y",)], "value string")).collect()
    assert {tuple(r) for r in rows} == {("a", "/w/x=1"), ("b", "/y")}
    for bad in (["a"], ["=x"], ["a="], ["a=/x", "a=/y"]):
        with pytest.raises(Exception, match="mapping is not|mapped twice"):
            surfaces.mappings(spark.createDataFrame([(b,) for b in bad], "value string")).collect()


def test_pointers_take_the_words_around_them(spark):
    fence = "```\nsee src/app/one.py\n```\n"
    text = "<!-- fix src/app/zero.py " + "x" * 200 + " -->" + fence + "Fix src/app/two.py::run" + " y" * 60 + " review src/app/three.py" + " z" * 60 + " lib/four.py"
    rows = surfaces.explicit_pointers(spark.createDataFrame([("i", "title", text), ("j", "notes", None), ("k", "title", "")], "issue_id string, source_field string, text string")).collect()
    got = {(r.issue_id, r.path, r.symbol, r.edit_intent, r.context_kind) for r in rows}
    assert got == {
        ("i", "src/app/one.py", None, "likely-edit", "code-fence"), ("i", "src/app/two.py", "run", "likely-edit", "prose"),
        ("i", "src/app/three.py", None, "reference-only", "prose"), ("i", "lib/four.py", None, "unknown", "prose"),
    }


def test_comments_keep_their_length(spark):
    cases = ["a <!-- b --> c <!----> d <!-- open", "<!--x-->y", "no", "-->", "<!-- a\nb --><!--c-->d"]
    got = [r.t for r in spark.createDataFrame([(c,) for c in cases], "t string").select(F.regexp_replace("t", surfaces.COMMENT_CHARACTER, " ").alias("t")).collect()]
    assert got == [re.sub("(?s)<!--.*?-->", lambda m: " " * len(m[0]), c) for c in cases]


def test_hashing_vectors(spark):
    texts = {"a": "Straße it's x-1 It's", "b": "", "c": None, "d": "w " * 5000}
    rows = V.hashing_vectors(spark.createDataFrame(list(texts.items()), "id string, text string"), 16).collect()
    for r in rows:
        want = np.zeros(16)
        for token in re.findall(r"[\w'-]+", (texts[r.id] or "").casefold()) or [""]:
            digest = hashlib.blake2b(token.encode(), digest_size=16).digest()
            want[int.from_bytes(digest[:8], "big") % 16] += 1 if digest[8] & 1 else -1
        assert np.allclose(r.v, want / np.linalg.norm(want))
    assert {r.id for r in rows} == set(texts)


def test_accounts_name_the_stage_that_leaks():
    counts = dict.fromkeys([c for _, name, parts in selection.ACCOUNTS for c in (name, *sum(parts.values(), ()))], 0)
    fine = {**counts, "total_non_parent_typed": 5, "inactive_or_closed_only": 2, "below_qualification": 1, "eligible": 2, "eligible_candidates": 1, "coalesced_eligible_edges": 1, "admitted": 1}
    assert selection.check_accounts(fine) == fine
    for key, stage in (("below_qualification", "discovery"), ("coalesced_eligible_edges", "edge-to-candidate"), ("admitted", "admission")):
        with pytest.raises(selection.ConservationError, match=stage):
            selection.check_accounts({**fine, key: fine[key] + 1})


def test_context_receipts_and_shadow_packet(spark):
    records = spark.createDataFrame([(f"r{k}", f"t{k}", "", "", "", "closed" if k == 3 else "open", "r1" if k == 2 else None) for k in range(1, 8)], "id string, title string, description string, acceptance_criteria string, design string, status string, parent_id string")
    edges = spark.createDataFrame([("r1", "r4", "relates-to"), ("r1", "r3", "blocks"), ("r1", "r5", "blocks"), ("r1", "gone", "blocks"), ("r1", "r6", "related-to"), ("r4", "r1", "blocks")], "source_id string, target_id string, relationship_type string")
    pool = spark.createDataFrame([("possible-overlap", "overlap", "r1", "r4", 0.9, "semantic-threshold", "semantic", None, 1), ("possible-overlap", "overlap", "r5", "r7", 0.8, "semantic-threshold", "semantic", None, 2)], "kind string, lane string, issue_id string, related_issue_id string, similarity double, admission_reason string, signal_quality string, reciprocal_evidence string, position int")
    packet = shadow.shadow_packet(pool, records, edges, records.filter("status = 'open'"), context_limit=2)
    one = next(c for c in packet["relationship_contexts"] if c["issue_id"] == "r1")
    assert [e["target_id"] for e in one["outgoing"]] == ["r4", "r5"] and one["omitted_outgoing_count"] == 3
    assert next(c for c in packet["relationship_contexts"] if c["issue_id"] == "r7") == {"issue_id": "r7", "incoming": [], "outgoing": [], "omitted_incoming_count": 0, "omitted_outgoing_count": 0}
    assert [(r["candidate_id"], r["likely_action"]) for r in packet["ranked_candidates"]] == [("possible-overlap|r5|r7", "intentional-follow-up"), ("possible-overlap|r1|r4", "intentional-follow-up")][::-1]
    assert packet["review_queues"]["informational"]["stopping_reason"] == "source-exhausted"
    stable = {k: v for k, v in packet.items() if k != "shadow_fingerprint"}
    assert packet["shadow_fingerprint"] == shadow.fingerprint(stable)
    for bad in (pool.union(pool), pool.withColumn("related_issue_id", F.lit("nobody")), pool.withColumn("related_issue_id", F.col("issue_id"))):
        with pytest.raises(ValueError):
            shadow.shadow_packet(bad, records, edges, records)


def test_freshness_order_of_actions(spark):
    rows = [("k", f"a{k}", "b", action, "action" if action in ("duplicate", "superseded-open", "missing-relation") else "informational", k) for k, action in enumerate(freshness.ACTION_ORDER[::-1])]
    df = spark.createDataFrame(rows, "kind string, issue_id string, related_issue_id string, likely_action string, review_tier string, position int")
    assert [r.likely_action for r in freshness.queue(df).orderBy("freshness_position").collect()] == list(freshness.ACTION_ORDER)


def test_ranked_review(spark, tmp_path):
    report = {"report_type": "sweep", "analysis_fingerprint": "f", "candidates": [{"kind": ("completed-work-echo", "possible-overlap")[k % 2], "issue_id": f"a{k}", "related_issue_id": f"b{k}", "similarity": 1 - k / 100} for k in range(60)]}
    path = tmp_path / "report.json"

    def read(value):
        path.write_text(value if isinstance(value, str) else json.dumps(value))
        return ranked_review.read_report(spark, f"file://{path}")

    loaded = read(report)
    assert loaded.first().input_sha256 == hashlib.sha256(path.read_bytes()).hexdigest()
    manifest, review = ranked_review.prepare(loaded, 50, "20,50", 4, "s")
    assert [(s["rank_bucket"], s["lane"], s["available"], s["sampled"]) for s in manifest["sampling"]["strata"]] == [("1-20", "echo", 10, 4), ("1-20", "overlap", 10, 4), ("21-50", "echo", 15, 4), ("21-50", "overlap", 15, 4)]
    assert [r["review_id"] for r in review["review_items"]] == [f"review-{k:03d}" for k in range(1, 17)]
    want = sorted((f"completed-work-echo|a{k}|b{k}" for k in range(0, 20, 2)), key=lambda c: hashlib.sha256(f"s\0stratum\0{c}".encode()).hexdigest())[:4]
    assert {r["candidate_id"] for r in manifest["sample"] if r["rank_bucket"] == "1-20" and r["lane"] == "echo"} == set(want)
    blind = sorted((r["candidate_id"] for r in manifest["sample"]), key=lambda c: hashlib.sha256(f"s\0blind-review-order\0{c}".encode()).hexdigest())
    assert [f"{r['issue_id']}|{r['related_issue_id']}" for r in review["review_items"]] == [c.split("|", 1)[1] for c in blind]
    assert "similarity" not in review["review_items"][0] and (manifest, review) == ranked_review.prepare(loaded, 50, "20,50", 4, "s")
    assert manifest["source"]["available_candidates"] == 60 and manifest["fixed_pool"]["actual_size"] == 50
    ranked_review.write(str(tmp_path / "out"), manifest, review)
    assert json.loads((tmp_path / "out" / "manifest.json").read_text()) == manifest
    for wrong in ({"report_type": "x", "candidates": []}, {"report_type": "sweep"}, {"report_type": "sweep", "candidates": 1}, [], "{"):
        with pytest.raises(ValueError):
            read(wrong)
    for bad in ([{"issue_id": "a", "related_issue_id": "b"}], [{"kind": "k", "issue_id": "a"}], [{"candidate_id": "x", "issue_id": "a", "related_issue_id": "b"}] * 2, [1]):
        with pytest.raises(ValueError):
            ranked_review.prepare(read({**report, "candidates": bad}))
    for bounds, pool in (("", 5), ("0,9", 5), ("5,5", 5), ("a", 5), ("4", 5)):
        with pytest.raises(ValueError):
            evaluate.parse_bounds(bounds, pool)
    with pytest.raises(ValueError):
        ranked_review.write(str(Path(__file__).parent / "x"), manifest, review)


def test_four_scorers(spark):
    records = spark.createDataFrame([("a", "Fix AB-12", "x"), ("b", "fix ab-12", "y"), ("c", "see AB-12", "z")], "id string, title string, description string")
    channels = [("a", "whole", [1.0, 0.0]), ("b", "whole", [0.6, 0.8]), ("c", "whole", [0.0, 1.0]), ("a", "title", [1.0, 0.0]), ("b", "title", [1.0, 0.0])]
    tokens = [("a", "p"), ("a", "q"), ("b", "p"), ("c", "r")]
    judged = spark.createDataFrame([("a", "b", 2), ("a", "c", 1), ("b", "c", 0)], "left_id string, right_id string, rating int")
    rows = evaluate.judged_scores(judged, records, spark.createDataFrame(channels, "id string, channel string, v array<double>"), spark.createDataFrame(tokens, "id string, token string"))
    got = {(r.left_id, r.right_id): r for r in rows.collect()}
    assert (got["a", "b"].whole_record_score, got["a", "b"].field_aware_score, got["a", "b"].selected_channel, got["a", "b"].exact_identifier_score) == (0.6, 1.0, "title", 1.0)
    assert got["a", "c"].exact_identifier_score == 0.9 and got["a", "c"].sparse_tfidf_score == 0.0 and 0 < got["a", "b"].sparse_tfidf_score < 1
    summary = {r.scorer: r for r in evaluate.scorer_summary(rows, 1, 0.72).collect()}
    assert set(summary) == set(evaluate.SCORERS) and summary["field_aware_score"].precision_at_budget == 1.0


def test_caps_skip_blocks_and_lose_no_pair(spark):
    rng = np.random.default_rng(5)
    means = rng.standard_normal((6, 24)) * 4
    for name, points in (("clustered", means[np.arange(600) % 6] + rng.standard_normal((600, 24)) * 0.3), ("random", rng.standard_normal((600, 24)))):
        unit = points / np.linalg.norm(points, axis=1)[:, None]
        rows = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(unit)], "id long, v array<double>")
        blocks = V.pack(rows, 50)
        got = {(r.left_id, r.right_id) for r in V.pairs_above(blocks, None, 0.6).collect()}
        i, j = np.nonzero(np.triu(unit @ unit.T >= 0.6, 1))
        assert got == set(zip(i.tolist(), j.tolist()))
        skipped, pairs = blocks.skipped(None, 0.6)
        assert pairs == len(blocks.numbers) * (len(blocks.numbers) + 1) // 2 and (skipped > 0) == (name == "clustered")


def test_views_in_one_pass(spark):
    rng = np.random.default_rng(6)
    rows, unit = [], {}
    for k in range(90):
        for channel, width in (("whole", 8), ("title", 5), ("body", 3)):
            if channel == "whole" or rng.random() < 0.6:
                v = rng.standard_normal(width)
                unit[f"r{k:02d}", channel] = v / np.linalg.norm(v)
                rows.append((f"r{k:02d}", channel, unit[f"r{k:02d}", channel].tolist()))
    table = spark.createDataFrame(rows, "id string, channel string, v array<double>")
    got = {(r.left_id, r.right_id): r.score for r in V.multi_view_pairs(table, 0.5, 20).collect()}
    names = sorted({i for i, _ in unit})
    best = {(a, b): max(float(unit[a, c] @ unit[b, c]) for c in ("whole", "title", "body") if (a, c) in unit and (b, c) in unit) for n, a in enumerate(names) for b in names[n + 1 :]}
    want = {pair: score for pair, score in best.items() if score >= 0.5}
    assert got.keys() == want.keys() and all(abs(got[p] - want[p]) < 1e-12 for p in want)


def test_admissible_pairs_are_those_of_all_pairs(spark):
    """The pass keeps what reaches the threshold or has one parent; with ``best`` the first of each left row, copies too."""
    rng = np.random.default_rng(11)
    vectors = rng.normal(size=(90, 5))
    vectors[40:60] = vectors[40]  # more copies than any row may keep
    vectors /= np.linalg.norm(vectors, axis=1)[:, None]
    tags = rng.integers(0, 3, 90)
    rows = spark.createDataFrame([(f"d{k:03d}", v.tolist(), int(t)) for k, (v, t) in enumerate(zip(vectors, tags, strict=True))], "id string, v array<double>, tag long")
    scores = np.clip(vectors @ vectors.T, -1, 1)
    fits = (scores >= 0.6) | ((scores >= 0.2) & (tags[:, None] == tags[None, :]) & (tags[:, None] > 0))
    for block in (1000, 25):
        got = V.admissible_pairs(rows, None, 0.6, 0.2, block_rows=block).collect()
        want = {(f"d{i:03d}", f"d{j:03d}") for i, j in zip(*np.nonzero(np.triu(fits, 1)), strict=True)}
        assert {(r.left_id, r.right_id) for r in got} == want and len(got) == len(want)
        right = rows.filter("id >= 'd030'")
        got = V.admissible_pairs(rows.filter("id < 'd030'"), right, 0.6, 0.2, 3, block).collect()
        have = {(r.left_id, r.right_id) for r in got}
        for i in range(30):
            for low in (False, True):
                mine = sorted((-round(scores[i, j], 6), f"d{j:03d}") for j in range(30, 90) if fits[i, j] and (scores[i, j] < 0.6) == low)
                assert {(f"d{i:03d}", j) for _, j in mine[:3]} <= have
        assert len(have) < int(fits[:30, 30:].sum())


def test_qualification_leaves_unneeded_pairs_in_the_tiles(spark, sf_dir):
    """Below the threshold only pairs with an exception leave the all-pairs pass, and of echoes the first few."""
    from quillon.catalog import Inputs
    from quillon.operators import qualify

    policy = CandidatePolicy(echo_threshold=0.2, overlap_threshold=0.9, exception_margin=1.0)
    staged, keep = {}, qualify.stage
    qualify.stage = lambda df, label: staged.setdefault((label, len(staged)), keep(df, label))
    try:
        i = Inputs(spark, sf_dir)
        i.qualified(policy).count()
        whole = i.active_vectors.count() * i.closed_vectors.count()
    finally:
        qualify.stage = keep
    echoes = [df for (label, _), df in staged.items() if label == "pairs"][1]
    assert echoes.count() < whole / 4


def test_cued_pairs_are_those_of_every_pair(spark):
    """The pairs found through names are those that a test of every pair finds, with odd ids and odd neighbours of an id."""
    texts = {
        "doc-1": "depends on doc-2. and so on", "doc-2": "after ßDOC-3", "doc-3": "blocked by doc-4.x", "doc-4": "related doc-1.. x", "doc-5": "supersedes xdoc-1 and -doc-2",
        "kit.7": "follow-up doc-5._", "a b": "depends on KIT.7", "c/d": "after a b!", "doc-6": "before c/d, doc-1", "s.": "relates to s.; doc-6", "doc-7": "seeKit.7 depends on KIT.7", "doc-8": "",
        "doc-9": "x" * 4085 + " after doc-8",
    }
    records = spark.createDataFrame([(k, f"title of {k}", v, None, "", "open", None) for k, v in texts.items()], "id string, title string, description string, acceptance_criteria string, design string, status string, parent_id string")
    ids = records.select("id")
    pairs = ids.toDF("issue_id").crossJoin(ids.toDF("related_issue_id")).filter("issue_id <> related_issue_id")
    every = pairs.join(records.withColumnRenamed("id", "issue_id"), "issue_id").filter(freshness.reference_with_cue(F.col("description"), F.col("related_issue_id")))
    want = {tuple(sorted(r)) for r in every.select("issue_id", "related_issue_id").collect()}
    pairs = pairs.coalesce(2).cache()
    for shapes in (50, 1):  # ids by their shapes, and runs of characters
        got = [tuple(r) for r in freshness.cued_pairs(pairs, records, shapes).collect()]
        assert {tuple(sorted(p)) for p in got} == want and len(got) == 2 * len(want) and len(want) > 6
    plain, nine = records.filter("id LIKE 'doc-%'"), pairs.filter("issue_id LIKE 'doc-%' AND related_issue_id LIKE 'doc-%'")
    got = {tuple(sorted(r)) for r in freshness.cued_pairs(nine, plain).collect()}
    assert got == {p for p in want if all(x.startswith("doc-") for x in p)} and not any("doc-8" in p for p in got)


def test_classification_carries_no_texts(spark, sf_dir):
    """Candidates meet titles as digests and texts only where one names the other."""
    from quillon.catalog import Inputs

    i = Inputs(spark, sf_dir)
    pool = i.qualified().withColumn("position", F.lit(1))
    plan = freshness.classify(pool, i.records, i.edges, i.active)._jdf.queryExecution().optimizedPlan().toString()
    assert "acceptance_criteria" not in plan and "description" not in plan


def test_consumers_outside_the_pair(spark):
    edges = spark.createDataFrame([(s, "t") for s in ("a", "b", "c")] + [("b", "u"), ("t", "u"), ("z", "w")], "source_id string, target_id string")
    active = spark.createDataFrame([(x,) for x in "abctu"], "id string")
    pairs = spark.createDataFrame([("a", "t"), ("b", "t"), ("t", "u"), ("b", "u"), ("w", "z"), ("w", "a")], "issue_id string, related_issue_id string")
    got = {tuple(r) for r in freshness.third_party_consumer(pairs, edges, active).collect()}
    assert got == {("a", "t"), ("b", "t"), ("t", "u"), ("b", "u")}


def test_ranks_of_pairs_copy_a_vector_for_blocks_not_for_pairs(spark):
    """Copies and near ties on both sides of a target; what pairs bring along are scores."""
    rng = np.random.default_rng(5)
    vectors = rng.normal(size=(80, 4))
    vectors[20:40] = vectors[20]
    vectors /= np.linalg.norm(vectors, axis=1)[:, None]
    names = [f"d{k:03d}" for k in range(80)]
    rows = spark.createDataFrame([(n, v.tolist()) for n, v in zip(names, vectors, strict=True)], "id string, v array<double>")
    pairs = [(a, b) for a in (0, 5, 21, 22, 70) for b in range(80) if a != b]
    asked = spark.createDataFrame([(names[a], names[b]) for a, b in pairs], "query_id string, target_id string")
    blocks, pool = V.pack(rows, 20), V.pack(rows.filter("id >= 'd010'"), 20)
    scored = V.pair_scores(asked, blocks, blocks)
    got = {(r.query_id, r.target_id): r.rank for r in V.pair_ranks(scored, blocks, pool).collect()}
    scores = np.round(vectors @ vectors.T, 12)
    want = {
        (names[a], names[b]): 1 + sum(scores[a, p] > scores[a, b] or (scores[a, p] == scores[a, b] and p < b) for p in range(10, 80) if p not in (a, b))
        for a, b in pairs
    }
    assert got == want and scored.columns == ["query_id", "target_id", "score"]


def test_best_of_a_left_row_are_those_of_its_block_pair_not_of_each_tile(spark):
    rng = np.random.default_rng(3)
    left, right = rng.normal(size=(6, 3)), rng.normal(size=(3 * V.TILE_ROWS, 3))
    left, right = (m / np.linalg.norm(m, axis=1)[:, None] for m in (left, right))
    rows = [spark.createDataFrame([(f"{side}{k:06d}", v.tolist()) for k, v in enumerate(m)], "id string, v array<double>") for side, m in (("a", left), ("b", right))]
    got = V.admissible_pairs(*rows, 0.5, 0.5, 4, block_rows=4 * V.TILE_ROWS).collect()
    scores = left @ right.T
    best = {(f"a{i:06d}", f"b{j:06d}") for i in range(6) for j in np.argsort(-scores[i])[:4]}
    assert best <= {(r.left_id, r.right_id) for r in got} and len(got) < 2 * len(best)
    assert not V.admissible_pairs(*rows, 1.0, 1.0, 4, block_rows=4 * V.TILE_ROWS).filter("score < 1").count()  # tiles with no pair


def test_parents_are_looked_up_only_of_pairs_that_can_have_one_in_common(spark):
    records = spark.createDataFrame([("a", None), ("b", "a"), ("c", "a"), ("d", "a")], "id string, parent_id string")
    edges = spark.createDataFrame([("c", "d", "blocks")], "source_id string, target_id string, relationship_type string")
    pairs = spark.createDataFrame([("a", "b", False), ("b", "c", True), ("b", "d", None), ("c", "d", True), ("d", "b", False)], "left_id string, right_id string, alike boolean")
    rows = relations.with_structure(pairs, records, edges)
    got = {(r.left_id, r.right_id): r.structural_context for r in rows.collect()}
    want = {("a", "b"): "parent/child", ("b", "c"): "same parent a", ("b", "d"): "same parent a", ("c", "d"): "c depends on d (blocks)", ("d", "b"): "none recorded"}
    assert got == want and "alike" not in rows.columns
