"""Readers of handed-over files, writers, and the shapes that they refuse."""

import json
import stat

import pytest
from pyspark.sql import functions as F

from quillon.operators import surfaces
from quillon.sources import host_pages, sinks, trackers


def put(path, payload):
    path.write_text(payload if isinstance(payload, str) else json.dumps(payload))
    return str(path)


RECORDS = [
    {"id": " a ", "title": "A", "status": "open", "priority": "P1", "labels": ["x", {"name": " y "}, "x"], "type": "bug", "body": "text",
     "dependencies": [{"issue_id": "a", "depends_on_id": "b", "type": "blocks"}, "b", "b"], "updatedAt": "2024-01-01T00:00:00.6Z"},
    {"id": "b", "title": "B", "status": "closed", "priority": 2, "parent": {"id": "a"}, "ephemeral": True, "extra": {"id": "z"}},
]


@pytest.mark.parametrize("wrap", [None, "issues", "items", "data"])
def test_records(spark, tmp_path, wrap):
    listing = put(tmp_path / "list.json", {wrap: RECORDS} if wrap else RECORDS)
    a, b = trackers.TrackerFiles(spark, listing).records().orderBy("id").collect()
    assert (a.id, a.priority, a.labels, a.issue_type, a.description) == ("a", 1, ["x", "y"], "bug", "text")
    assert a.dependencies == ["b"] and [tuple(p) for p in a.links] == [("b", "blocks"), ("b", "depends-on")]
    assert (b.parent_id, b.ephemeral, b.priority, b.links, b.description) == ("a", True, 2, [], "")


@pytest.mark.parametrize(
    "payload",
    [
        {"results": RECORDS}, {"issues": RECORDS, "data": []}, "7", [{"title": "A", "status": "open"}], [{"id": "a", "title": " ", "status": "open"}],
        [dict(RECORDS[1], priority=7)], [dict(RECORDS[1], labels=[{"nom": "x"}])], [dict(RECORDS[1], dependencies=["b"])], [RECORDS[1], RECORDS[1]],
    ],
)
def test_other_shapes_fail(spark, tmp_path, payload):
    with pytest.raises(Exception):
        trackers.TrackerFiles(spark, put(tmp_path / "list.json", payload)).records().collect()


def test_snapshot_and_export(spark, tmp_path):
    listing, context = put(tmp_path / "l.json", RECORDS), put(tmp_path / "c.json", {"path": "/w", "workspace_id": None})
    version = put(tmp_path / "v.json", {"version": "1.2.0"})
    same = [dict(RECORDS[0], updatedAt="2024-01-01T02:00:01+02:00", status="OPEN"), RECORDS[1]]
    load = lambda lines: trackers.TrackerFiles(spark, listing, context, version, put(tmp_path / "e.jsonl", lines)).load()[0]
    snap = load("\n".join(map(json.dumps, same)) + "\n\n")
    assert snap.live_digest == snap.export_digest and not snap.warnings and snap.records == snap.exported == 2
    assert snap.edge_types == (("blocks", 1), ("depends-on", 1)) and snap.version == "1.2.0" and len(snap.workspace_id) == 64
    other = load("\n".join(map(json.dumps, [dict(RECORDS[0], status="closed"), RECORDS[1]])))
    assert other.divergence == ("status",) and other.warnings
    assert load(json.dumps(RECORDS[1])).divergence == ("issue_identity", "record_count")
    broken = load(json.dumps(RECORDS[1]) + "\n{not json")
    assert broken.export_digest is None and len(broken.warnings) == 1


def test_versions():
    assert trackers.check_version("1.0.5") == "1.0.5"
    for text in ("1.0.5-rc1", "1.0.4", "new", ""):
        with pytest.raises(trackers.SourceError):
            trackers.check_version(text)


def page(name, rows, more=False, cursor=None):
    return {name: {"nodes": rows, "pageInfo": {"hasNextPage": more, "endCursor": cursor}}}


def issue(key, **more):
    return {"identifier": key, "title": key, "description": None, "priority": 3, "updatedAt": "2024-01-01T00:00:00Z", "state": {"type": "started"},
            "labels": {"nodes": [{"name": "l"}], "pageInfo": {"hasNextPage": False}}, **more}


def relation(a, b, kind):
    return {"type": kind, "issue": {"identifier": a}, "relatedIssue": {"identifier": b}}


def test_host_pages(spark, tmp_path):
    one = put(tmp_path / "1.json", page("issues", [issue("A"), issue("B", state={"type": "canceled"}, parent={"identifier": "A"})], True, "c1"))
    two = put(tmp_path / "2.json", page("issues", [issue("C", priority=0)]))
    rels = [relation("B", "A", "related"), relation("A", "B", "related"), relation("A", "B", "blocks"), relation("C", "Z", "blocks"), relation("Y", "Z", "similar")]
    r = put(tmp_path / "r.json", page("issueRelations", rels))
    snap, records = host_pages.HostPages(spark, "o", "t", [one, two], [r]).load()
    rows = {x.id: x for x in records.collect()}
    assert [rows[k].status for k in "ABC"] == ["in_progress", "closed", "in_progress"] and rows["B"].parent_id == "A"
    assert [tuple(p) for p in rows["A"].links] == [("B", "blocks")] and rows["B"].links == []
    assert snap.edge_types == (("blocks", 1),) and snap.warnings == ("relations that leave the team: blocks=1, similar-to=1",)
    for pages in ([one], [two, one], [one, one, two]):
        with pytest.raises(trackers.SourceError):
            host_pages.nodes(spark, pages, "issues")
    with pytest.raises(trackers.SourceError):
        host_pages.refuse_writes("mutation { x }")


def test_team_lookup(spark):
    teams = spark.createDataFrame([(json.dumps({"id": str(k), "key": key, "name": name}),) for k, (key, name) in enumerate([("ENG", "Core"), ("OPS", "Twin"), ("WEB", "twin")])], "node string")
    assert host_pages.pick_team(teams, "eng") == ("0", "ENG")
    for wanted in ("twin", "none"):
        with pytest.raises(trackers.SourceError):
            host_pages.pick_team(teams, wanted)


def test_reports_are_private_and_whole(tmp_path):
    paths = sinks.report_folder(tmp_path / "out", "report", {"b": 1, "a": 2}, "# r\n", [({"n": 1}, "# 1\n")])
    assert [p.name for p in paths] == ["report.json", "report.md", "batch-1.json", "batch-1.md"]
    assert stat.S_IMODE(paths[0].stat().st_mode) == 0o600 and len(list((tmp_path / "out").iterdir())) == 4
    assert sinks.output_paths("x.MD", None, "s", "r")[2] == "markdown" and sinks.output_paths(None, None, "s", "r")[0].name == "r"
    with pytest.raises(ValueError):
        sinks.outside(tmp_path / "a" / "c", tmp_path)
    assert (sinks.exit_code(True, True), sinks.exit_code(True, False)) == (3, 0)


def test_checkpoints(spark, tmp_path):
    state = spark.createDataFrame([("a", "2024-01-01T00:00:00Z", "0" * 64), ("b", "", "f" * 64)], "id string, updated_at string, fingerprint string")
    sinks.write_checkpoint(state, str(tmp_path / "ok"), "w", "2024-02-01T00:00:00Z")
    assert sinks.read_checkpoint(spark, str(tmp_path / "ok"), "w", "2024-03-01T00:00:00Z").count() == 2
    for workspace, now in (("v", "2024-03-01T00:00:00Z"), ("w", "2024-01-15T00:00:00Z")):
        with pytest.raises(ValueError, match="refused"):
            sinks.read_checkpoint(spark, str(tmp_path / "ok"), workspace, now)
    sinks.write_checkpoint(state.withColumn("fingerprint", F.lit("xyz")), str(tmp_path / "bad"), "w", "2024-02-01T00:00:00Z")
    with pytest.raises(ValueError, match="fingerprint"):
        sinks.read_checkpoint(spark, str(tmp_path / "bad"), "w", "2024-03-01T00:00:00Z")


def test_worktrees(spark):
    issues = spark.createDataFrame([("p-1.7",), ("p-2.8",), ("q-3.8",), ("solo",), ("other",)], "issue_id string")
    trees = spark.createDataFrame(
        [("/0", "solo"), ("/1", "fix/bead-7"), ("/2", "bead-8"), ("/3", "x/SOLO_other"), ("/4", "solo-other"), ("/5", None), ("/6", "unsolo"), ("/7", "main")], "path string, branch string"
    )
    none = issues.limit(0).withColumn("path", F.lit(""))
    got = {r.issue_id: r.path for r in surfaces.associate_worktrees(issues, trees, none).collect()}
    assert got == {"solo": "/0", "p-1.7": "/1", "other": "/3"}
    named = spark.createDataFrame([("q-3.8", "/0")], "issue_id string, path string")
    got = {r.issue_id: r.path for r in surfaces.associate_worktrees(issues, trees, named).collect()}
    assert got == {"q-3.8": "/0", "p-1.7": "/1"}


def test_repository_context():
    pick = surfaces.repository_context
    assert pick(("/a", "/g"), ("/b", "/g"))[:2] == ("/a", "invocation-worktree")
    assert pick(("/a", "/g"), ("/b", "/h"))[:2] == ("/b", "tracker-workspace")
    assert pick(None, None)[:2] == (None, "unavailable") and pick(("/a", "/g"), None)[2]


def test_path_presence(spark):
    pointers = spark.createDataFrame([("src/a.py",), ("src/",), ("b.py",)], "path string")
    listing = spark.createDataFrame([("src/a.py",), ("src/b/c.py",)], "path string")
    assert {r.path: r.path_presence for r in surfaces.path_presence(pointers, listing).collect()} == {"src/a.py": "existing", "src/": "existing", "b.py": "missing"}
