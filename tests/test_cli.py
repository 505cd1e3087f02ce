"""Commands from end to end over a small tracker."""

import json

import pytest

from quillon import cli


@pytest.fixture(scope="module")
def tracker(tmp_path_factory):
    root = tmp_path_factory.mktemp("tracker")
    same = "cache the parser output of the request endpoint and verify the contract"
    rows = [
        {"id": "t-1", "title": "Cache parser | output", "status": "open", "description": f"Fix src/app/parse.py: {same}", "dependencies": [{"depends_on_id": "t-2", "type": "blocks"}]},
        {"id": "t-2", "title": "Cache parser output too", "status": "open", "description": f"Change src/app/parse.py: {same}"},
        {"id": "t-3", "title": "Cache parser output", "status": "closed", "description": f"done: {same}"},
        {"id": "t-4", "title": "Paint the shed", "status": "open", "description": "green walls, white door"},
        {"id": "t-5", "title": "Epic", "status": "open", "issue_type": "epic", "description": same},
        {"id": "t-6", "title": "?!", "status": "open", "description": ""},
    ]
    (root / "list.json").write_text(json.dumps(rows))
    (root / "context.json").write_text(json.dumps({"project_id": "p"}))
    (root / "export.jsonl").write_text("\n".join(json.dumps(dict(r, status="open")) for r in rows))
    return root


def ask(spark, tracker, capsys, *more, export=False):
    given = ["--list", str(tracker / "list.json"), "--context", str(tracker / "context.json")]
    given += ["--export", str(tracker / "export.jsonl")] if export else []
    code = cli.run([*given, *more], spark)
    out = capsys.readouterr()
    return code, out.out, out.err


def test_triage(spark, tracker, capsys):
    code, out, _ = ask(spark, tracker, capsys, "triage", "--json", "--overlap-threshold", "0.5", "--echo-threshold", "0.5")
    report = json.loads(out)
    found = {(c["lane"], c["issue_id"], c["related_issue_id"]) for c in report["candidates"]}
    assert code == 0 and ("dependency", "t-1", "t-2") in found and any(c[2] == "t-3" for c in found)
    assert not any("t-4" in c or "t-5" in c for c in found) and report["population"] == {"records": 6, "active": 4, "no_signal": 2, "excluded": 2}
    assert [c["shared_paths"] for c in report["collisions"]] == [["src/app/parse.py"]] and report["policy"]["read_only"]


def test_sweep_folder_and_divergence(spark, tracker, tmp_path, capsys):
    options = ("sweep", "--overlap-threshold", "0.5", "--output-dir", str(tmp_path / "out"), "--fail-on-divergence")
    code, _, _ = ask(spark, tracker, capsys, *options, export=True)
    report = json.loads((tmp_path / "out" / "report.json").read_text())
    assert code == 3 and report["snapshot"]["divergence"] == ["status"] and (tmp_path / "out" / "batch-1.md").exists()
    first = report["analysis_fingerprint"]
    assert ask(spark, tracker, capsys, *options[:3], "--output", str(tmp_path / "x.json"))[0] == 0
    assert json.loads((tmp_path / "x.json").read_text())["analysis_fingerprint"] == first
    assert "t-1" in (tmp_path / "out" / "report.md").read_text()


def test_neighbours_and_collisions(spark, tracker, capsys):
    _, out, _ = ask(spark, tracker, capsys, "neighbors", "t-3", "--limit", "1", "--json")
    assert json.loads(out)["neighbors"][0]["candidate_id"] in ("t-1", "t-2")
    _, out, _ = ask(spark, tracker, capsys, "neighbors", "t-2", "--limit", "3", "--include-closed")
    assert "Cache parser \\| output" in out
    _, out, _ = ask(spark, tracker, capsys, "collisions")
    assert "src/app/parse.py" in out
    code, _, err = ask(spark, tracker, capsys, "neighbors", "t-9")
    assert code == 2 and "vector" in err


def test_small_commands(spark, capsys):
    assert cli.run(["capabilities", "--json"]) == 0 and json.loads(capsys.readouterr().out)["required_capabilities"] == ["read-only-review"]
    assert cli.run(["readiness", "--json"], spark) == 0 and json.loads(capsys.readouterr().out)["ready"]
    assert cli.run(["doctor", "--json"]) == 2 and json.loads(capsys.readouterr().out)["status"] == "blocked"
    assert cli.run(["triage", "--max-candidates-per-issue", "0"], spark) == 2
    assert cli.guard(["--list", "sweep", "triage"])[-1] == "--json"
    for bad in (["neighbors", "x"], ["triage", "--output=x"], ["--list"], []):
        with pytest.raises(ValueError):
            cli.guard(bad)


def test_incremental_runs(spark, tracker, tmp_path, capsys):
    given = ["triage", "--json", "--overlap-threshold", "0.5", "--echo-threshold", "0.5"]
    mark = str(tmp_path / "mark")
    assert ask(spark, tracker, capsys, *given, "--write-checkpoint", mark)[0] == 0
    _, out, _ = ask(spark, tracker, capsys, *given, "--checkpoint", mark)
    assert json.loads(out)["candidates"] == []
    rows = json.loads((tracker / "list.json").read_text())
    other = tmp_path / "later"
    other.mkdir()
    rows[1]["title"] += " again"
    (other / "list.json").write_text(json.dumps(rows))
    (other / "context.json").write_text((tracker / "context.json").read_text())
    _, out, _ = ask(spark, other, capsys, *given, "--checkpoint", mark)
    found = json.loads(out)["candidates"]
    assert found and all("t-2" in (c["issue_id"], c["related_issue_id"]) for c in found)
    code, _, err = ask(spark, tracker, capsys, *given, "--since", "yesterday")
    assert code == 2 and "--since" in err


def test_collisions_with_worktrees(spark, tracker, tmp_path, capsys):
    (tmp_path / "trees").write_text("worktree /w/one\nHEAD abc\nbranch refs/heads/fix/t-4\n\nworktree /w/two\nHEAD def\nbranch refs/heads/main\n")
    changes = [("/w/one", "src/app/parse.py", "working"), ("/w/one", "notes.bin", "untracked"), ("/w/two", "src/app/other.py", "committed")]
    (tmp_path / "changes.jsonl").write_text("\n".join(json.dumps(dict(zip(("worktree", "path", "kind"), c, strict=True))) for c in changes))
    (tmp_path / "files").write_text("src/app/parse.py\n")
    given = ["collisions", "--json", "--worktree-list", str(tmp_path / "trees"), "--changed-paths", str(tmp_path / "changes.jsonl"), "--repository-files", str(tmp_path / "files"), "--revision", "abc"]
    code, out, _ = ask(spark, tracker, capsys, *given)
    report = json.loads(out)
    by = {(c["issue_id"], c["related_issue_id"]): c for c in report["collisions"]}
    assert code == 0 and set(by) == {("t-1", "t-2"), ("t-1", "t-4"), ("t-2", "t-4")}
    assert by["t-1", "t-4"]["confidence"] == "corroborated" and by["t-1", "t-4"]["edit_intent"] == "observed-edit"
    assert by["t-1", "t-2"]["path_presence"] == "all-existing" and by["t-1", "t-2"]["revision_relation"] == "same"
    _, out, _ = ask(spark, tracker, capsys, *given, "--worktree", "t-1=/w/two")
    assert ("t-1", "t-2") in {(c["issue_id"], c["related_issue_id"]) for c in json.loads(out)["collisions"]}
    for bad, told in (("t-9=/w/one", "outside the review"), ("t-1=/w/x", "no worktree"), ("t-1", "ID=PATH")):
        code, _, err = ask(spark, tracker, capsys, *given, "--worktree", bad)
        assert code == 2 and told in err


def test_dependency_accounts_and_run_id(spark, tracker, capsys):
    _, out, _ = ask(spark, tracker, capsys, "sweep", "--json", "--max-dependency-candidates-per-issue", "0")
    report = json.loads(out)
    counts = report["dependency_accounts"]
    assert counts["total_non_parent_typed"] == 1 and counts["eligible_candidates"] == counts["admitted"] + counts["omitted_by_per_issue_cap"]
    assert report["analysis_status"] == "complete" and report["degradation_receipts"] == []
    import re

    assert re.fullmatch(r"\d{8}T\d{6}Z-[0-9a-f]{8}", report["run_id"])


def test_guards_and_scope_of_collisions(spark, tracker, tmp_path, capsys):
    given, mark = ["collisions", "--json", "--max-hub-surface-issues", "1", "--explain-hub-guard"], str(tmp_path / "mark.jsonl")
    _, out, _ = ask(spark, tracker, capsys, *given, "--write-checkpoint", mark)
    report = json.loads(out)
    assert report["collisions"] == [] and report["omitted_by_hub_guard"] == 1 and report["omitted_by_module_guard"] == 0
    assert [(x["issue_id"], x["related_issue_id"], x["suppressing_paths"]) for x in report["hub_guard_sample"]] == [("t-1", "t-2", ["src/app/parse.py"])]
    _, out, _ = ask(spark, tracker, capsys, *given, "--checkpoint", mark)
    assert json.loads(out)["omitted_by_hub_guard"] == 0 and json.loads(out)["hub_guard_sample"] == []
    code, _, err = ask(spark, tracker, capsys, "collisions", "--explain-hub-guard", "-1")
    assert code == 2 and "guarded_pairs" in err
