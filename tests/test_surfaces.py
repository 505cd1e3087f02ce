"""Collisions with symbols and scope, and what the guards hold back, against all pairs by hand."""

import itertools
import random

import pytest
from pyspark.sql import functions as F

from quillon.operators import surfaces

SCHEMA = "issue_id int, path string, symbol string, source string, edit_intent string, context_kind string, path_presence string, revision string, source_field string"


def module(path):
    parts = path.split("/")[:-1]
    return "/".join(parts[:2]) if parts else None


def pointers(seed, issues=120):
    rng, rows = random.Random(seed), []
    for issue in range(issues):
        seen = rng.random() < 0.15
        for _ in range(rng.randint(0, 6)):
            path = rng.choice([f"src/m{rng.randint(0, 9)}/f{rng.randint(0, 5)}.py", f"lib/x{rng.randint(0, 60)}/y{rng.randint(0, 9)}.py", f"root{rng.randint(0, 30)}.py", "app/hub/main.py", f"src/m{rng.randint(0, 9)}/"])
            symbol = f"run_{rng.randint(0, 3)}" if rng.random() < 0.2 and not path.endswith("/") else None
            facts = ("observed-edit", "observed-worktree") if seen else (rng.choice(["likely-edit", "reference-only", "unknown"]), rng.choice(["prose", "code-fence"]))
            rows.append((issue, path, symbol, surfaces.OBSERVED if seen else surfaces.EXPLICIT, *facts, rng.choice(["existing", "missing", "unavailable"]), rng.choice([None, "r1", "r2"]) if seen else None, rng.choice(["title", "notes", None])))
    return rows


def brute(rows, limit, scope=None, most=8):
    by = {}
    for r in rows:
        by.setdefault(r[0], []).append(r)
    paths = {i: {r[1] for r in own if not r[1].endswith("/")} for i, own in by.items()}
    modules = {i: {module(r[1]) for r in own} - {None} for i, own in by.items()}
    count = lambda sets, x: sum(x in s for s in sets.values())
    hub = lambda sets: {x for x in set().union(*sets.values()) if count(sets, x) > limit}
    hub_paths, hub_modules = hub(paths), hub(modules)
    hits, held, guarded = {}, [], 0
    for a, b in itertools.combinations(sorted(by), 2):
        if scope is not None and a not in scope and b not in scope:
            continue
        both = by[a] + by[b]
        watched = [r for r in both if r[3] == surfaces.OBSERVED]
        symbols = sorted({f"{r[1]}::{r[2]}" for r in by[a] if r[2]} & {f"{r[1]}::{r[2]}" for r in by[b] if r[2]})[:most]
        own = paths[a] & paths[b]
        kept = sorted(p for p in own if p not in hub_paths or p in {r[1] for r in watched})[:most]
        kept = sorted(set(kept) | {s.rsplit("::", 1)[0] for s in symbols})[:most]
        plain = sorted((modules[a] & modules[b]) - hub_modules)[:most]
        live = [m for m in plain if m in {module(r[1]) for r in watched}]
        if not kept and not symbols and not live:
            if plain:
                guarded += 1
            elif own or modules[a] & modules[b]:
                held.append((a, b, sorted(own & hub_paths)[:most], sorted(modules[a] & modules[b] & hub_modules)[:most]))
            continue
        told = [r for r in both if r[1] in kept or (r[2] and f"{r[1]}::{r[2]}" in symbols) or module(r[1]) in live]
        sides = [any(r[3] == surfaces.OBSERVED for r in told if r[0] == i) for i in (a, b)]
        revisions = {r[7] for r in both if r[7]}
        hits[a, b] = (kept, symbols, live, ["explicit", "corroborated", "observed"][sum(sides)], sorted({r[3] for r in told}), {r[4] for r in told}, {r[5] for r in told}, {r[6] for r in told}, min(len(revisions), 2), sorted({r[8] for r in told if r[8]}))
    return hits, held, guarded


@pytest.mark.parametrize(("seed", "limit", "scoped", "widest"), [(1, 4, False, 10), (3, 4, True, 2)])
def test_against_all_pairs(spark, seed, limit, scoped, widest):
    rows = pointers(seed)
    inside = {i for i in range(120) if i % 7 == 3} if scoped else None
    scope = spark.createDataFrame([(i,) for i in inside], "issue_id int") if scoped else None
    table = spark.createDataFrame(rows, SCHEMA)
    hits, held, guarded = brute(rows, limit, inside)
    found = surfaces.surfaces(table)
    shared = surfaces.shared_evidence(found, limit, scope=scope)
    got = {(r.issue_id, r.related_issue_id): r for r in surfaces.collisions(table, limit, scope=scope, shared=shared).collect()}
    assert got.keys() == hits.keys() and hits and held and guarded
    for pair, (paths, symbols, modules, confidence, sources, intents, contexts, presence, revisions, fields) in hits.items():
        r = got[pair]
        assert (r.shared_paths, r.shared_symbols, r.shared_modules, r.confidence, r.evidence_sources, r.intent_source_fields) == (paths, symbols, modules, confidence, sources, fields)
        assert r.kind == ("exact-file" if paths else "shared-module") and r.revision_relation == ["unavailable", "same", "different"][revisions]
        both = {"likely-edit", "reference-only"} <= intents
        assert r.edit_intent == next((v for v, fits in (("observed-edit", "observed-edit" in intents), ("mixed", both), ("likely-edit", "likely-edit" in intents), ("reference-only", "reference-only" in intents)) if fits), "unknown")
        assert r.context_kind == ("observed-worktree" if "observed-worktree" in contexts else "code-fence-only" if contexts == {"code-fence"} else "mixed" if "code-fence" in contexts else "prose")
        assert r.path_presence == {("existing",): "all-existing", ("missing",): "all-missing", ("unavailable",): "unavailable"}.get(tuple(presence), "mixed")
    assert surfaces.guard_counts(found, shared, limit, scope, widest) == {"omitted_by_hub_guard": len(held), "omitted_by_module_guard": guarded}
    sample = surfaces.hub_guard_sample(found, shared, limit, 5, scope=scope).orderBy("issue_id", "related_issue_id").collect()
    assert [tuple(r) for r in sample] == held[:5]


def test_a_symbol_brings_its_hub_path_back(spark):
    rows = [(i, "src/a/main.py", "run" if i < 2 else None, surfaces.EXPLICIT, "unknown", "prose", "existing", None, "title") for i in range(30)]
    table = spark.createDataFrame(rows, SCHEMA)
    got = surfaces.collisions(table, 5).collect()
    assert [(r.issue_id, r.related_issue_id, r.shared_paths, r.shared_symbols) for r in got] == [(0, 1, ["src/a/main.py"], ["src/a/main.py::run"])]
    found = surfaces.surfaces(table)
    assert surfaces.guard_counts(found, surfaces.shared_evidence(found, 5), 5)["omitted_by_hub_guard"] == 30 * 29 // 2 - 1


def test_counting_does_not_make_the_pairs(spark):
    rows = spark.range(20_000).select(F.col("id").cast("int").alias("issue_id"), F.lit("src/a/main.py").alias("path"), *[F.lit(None).cast("string").alias(c) for c in ("symbol", "edit_intent", "context_kind", "path_presence", "revision", "source_field")], F.lit(surfaces.EXPLICIT).alias("source"))
    found = surfaces.surfaces(rows)
    shared = surfaces.shared_evidence(found, 5)
    assert surfaces.guard_counts(found, shared, 5) == {"omitted_by_hub_guard": 20_000 * 19_999 // 2, "omitted_by_module_guard": 0}


def test_no_pointers(spark):
    found = surfaces.surfaces(spark.createDataFrame([], SCHEMA))
    shared = surfaces.shared_evidence(found, 5)
    assert surfaces.guard_counts(found, shared, 5) == {"omitted_by_hub_guard": 0, "omitted_by_module_guard": 0}
    assert surfaces.hub_guard_sample(found, shared, 5, 3).count() == 0 and surfaces.collisions(spark.createDataFrame([], SCHEMA), 5).count() == 0


def _touching(spark, work):
    """Pointers of issues to paths; every second issue was seen to change its own."""
    rows = [(i, path, None, surfaces.OBSERVED if i % 2 == 0 else surfaces.EXPLICIT, "unknown", "prose", "existing", None, "title") for i, paths in work.items() for path in paths]
    return spark.createDataFrame(rows, SCHEMA)


def test_pairs_with_one_hub_path_in_common_are_told_where_they_meet(spark):
    many = [f"src/n{k}/x.py" for k in range(surfaces.SIGNED)]
    work = {i: ["src/a/main.py", f"src/o{i}/y.py"] for i in range(12)}
    work[0], work[1] = [*work[0], "src/a/more.py"], [*work[1], "src/a/more.py"]  # two paths of one module
    work[2], work[3] = [*work[2], "src/b/z.py"], [*work[3], "src/b/z.py"]  # a path of another module
    work[4] = [*work[4], *many]  # too many surfaces for a signature
    shared = surfaces.shared_evidence(surfaces.surfaces(_touching(spark, work)), 5).collect()
    wide = {(min(i, 4), max(i, 4)) for i in work if i != 4}
    assert {(r.issue_id, r.related_issue_id) for r in shared if not r.on_hub} == {(0, 1), (2, 3)} | wide
    pairs = {(a, b) for a in work for b in work if a < b and (a % 2 == 0 or b % 2 == 0)}
    assert len(shared) == len(pairs) and {(r.issue_id, r.related_issue_id) for r in shared} == pairs
    by = {(r.issue_id, r.related_issue_id): r.shared_paths for r in shared}
    assert by[0, 1] == ["src/a/main.py", "src/a/more.py"] and by[2, 3] == ["src/a/main.py", "src/b/z.py"] and by[0, 2] == ["src/a/main.py"]


def test_pairs_on_hubs_are_counted_without_the_sets_of_one_issue(spark, monkeypatch):
    hubs = {i: sorted({i % 3, 10 + i % 4, 100 + i, 200 + i, 300 + i}) for i in range(24)}
    staged, kept = {}, surfaces.stage
    monkeypatch.setattr(surfaces, "stage", lambda df, label: staged.setdefault(label, kept(df, label)))
    got = surfaces._pairs_sharing(spark.createDataFrame(list(hubs.items()), "issue_id int, hubs array<int>"), 10)
    assert got == sum(bool({*hubs[a]} & {*hubs[b]}) for a in hubs for b in hubs if a < b)
    assert staged["hub-pairs"].count() == 12  # of 240 pairs of hubs
