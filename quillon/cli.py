"""Command line: ``python -m quillon <command>``. Reads snapshots, writes reports only.

Exit 0: done; 2: wrong input or blocked; 3: the export diverged and that was to be refused.
"""

from __future__ import annotations

import argparse
import sys
import uuid
from datetime import UTC, datetime
from pathlib import Path

from quillon.model import ACTIVE_STATUSES, CandidatePolicy
from quillon.operators.selection import lane_reservations
from quillon.sources import markdown, sinks

REPORTS = ("triage", "sweep", "batch", "neighbors", "collisions")
ABILITIES = ("read-only-review", "bounded-queue", "typed-dependencies", "code-surfaces", "freshness", "json", "markdown")
GUARDED = ("triage", "sweep", "collisions")
WRITERS = ("--output", "--output-dir")
TAKES_VALUE = ("--list", "--context", "--tracker-version", "--export", "--vectors", "--vector-cache", "--master")
STATE = ["title", "description", "acceptance_criteria", "design", "notes", "status", "issue_type", "priority", "parent_id", "labels", "links"]


def _policy_options(p: argparse.ArgumentParser) -> None:
    d = CandidatePolicy()
    for name, kind, value in (
        ("echo-threshold", float, d.echo_threshold), ("overlap-threshold", float, d.overlap_threshold), ("exception-margin", float, d.exception_margin),
        ("reciprocal-rank", int, d.reciprocal_rank), ("max-candidates-per-issue", int, d.max_per_issue), ("max-echoes-per-target", int, d.max_echoes_per_target),
        ("max-echo-alternatives-per-active", int, d.max_echo_alternatives_per_active), ("max-dependency-candidates-per-issue", int, d.max_dependencies_per_issue),
        ("max-dependency-candidates", int, d.max_dependencies), ("max-echo-candidates", int, d.max_echoes), ("max-overlap-candidates", int, d.max_overlaps),
    ):
        p.add_argument(f"--{name}", type=kind, default=value)
    total = p.add_mutually_exclusive_group()
    total.add_argument("--max-candidates", type=int)
    total.add_argument("--review-budget", "--weekly-review-budget", type=int)
    p.add_argument("--objective", action="append", choices=("collision", "overlap", "echo", "structure"))


def _surface_options(p: argparse.ArgumentParser, on: bool) -> None:
    switch = p.add_mutually_exclusive_group()
    switch.add_argument("--code-surfaces", action="store_true", default=on, dest="code_surfaces")
    switch.add_argument("--no-code-surfaces", action="store_false", dest="code_surfaces")
    p.add_argument("--worktree", action="append", default=[], metavar="ID=PATH")
    for name in ("--repository-files", "--worktree-list", "--changed-paths", "--revision"):
        p.add_argument(name)
    p.add_argument("--max-hub-surface-issues", type=int, default=5)
    p.add_argument("--explain-hub-guard", type=int, nargs="?", const=5, default=0, metavar="PAIRS")


def _incremental_options(p: argparse.ArgumentParser) -> None:
    scope = p.add_mutually_exclusive_group()
    scope.add_argument("--since")
    scope.add_argument("--checkpoint")
    p.add_argument("--write-checkpoint")


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="quillon")
    for name in TAKES_VALUE:
        top.add_argument(name)
    commands = top.add_subparsers(dest="command", required=True)
    for name in (*REPORTS, "readiness", "capabilities", "doctor"):
        p = commands.add_parser(name)
        p.add_argument("--json", action="store_true", dest="as_json")
        if name not in REPORTS:
            continue
        p.add_argument("--fail-on-divergence", action="store_true")
        p.add_argument("--status", action="append")
        p.add_argument("--include-epics", action="store_true")
        p.add_argument("--include-ephemeral", action="store_true")
        where = p.add_mutually_exclusive_group()
        where.add_argument("--output")
        where.add_argument("--output-dir")
        if name == "neighbors":
            p.add_argument("issue_id")
            p.add_argument("--limit", type=int, default=5)
            p.add_argument("--include-closed", action="store_true")
        if name in ("triage", "sweep", "batch", "collisions"):
            _incremental_options(p)
        if name in ("triage", "sweep", "batch"):
            _policy_options(p)
            p.add_argument("--max-batch-size", "--size", type=int, default=9)
        if name in GUARDED or name == "batch":
            _surface_options(p, name in ("triage", "collisions"))
    return top


def policy_of(args: argparse.Namespace) -> CandidatePolicy:
    if not hasattr(args, "echo_threshold"):
        return CandidatePolicy()
    budget = args.review_budget if args.review_budget is not None else 20 if args.command == "triage" and args.max_candidates is None else None
    total = budget if budget is not None else args.max_candidates or CandidatePolicy().max_total
    wanted = frozenset(args.objective) if args.objective else None
    named = {
        "echo_threshold": args.echo_threshold, "overlap_threshold": args.overlap_threshold, "exception_margin": args.exception_margin, "reciprocal_rank": args.reciprocal_rank,
        "max_per_issue": args.max_candidates_per_issue, "max_echoes_per_target": args.max_echoes_per_target, "max_echo_alternatives_per_active": args.max_echo_alternatives_per_active,
        "max_dependencies_per_issue": args.max_dependency_candidates_per_issue, "max_dependencies": args.max_dependency_candidates, "max_echoes": args.max_echo_candidates,
        "max_overlaps": args.max_overlap_candidates, "max_total": total, "objectives": wanted,
    }
    plain = CandidatePolicy(**named)
    return CandidatePolicy(**named, lane_reservations=lane_reservations(total, plain.lane_caps)) if budget is not None else plain


def _spark(master: str | None):
    from pyspark.sql import SparkSession

    builder = SparkSession.builder.appName("quillon").config("spark.sql.session.timeZone", "UTC").config("spark.ui.showConsoleProgress", "false")
    return (builder.master(master) if master else builder).getOrCreate()


def _review(args: argparse.Namespace, spark):
    from quillon.operators.vectors import unit_vectors
    from quillon.plans.review import Options, Review
    from quillon.sources.trackers import SourceError, TrackerFiles

    if not args.list:
        raise SourceError("--list names no file")
    snapshot, records = TrackerFiles(spark, args.list, args.context, args.tracker_version, args.export).load()
    vectors = unit_vectors(spark.read.parquet(args.vectors), "id", "embedding") if args.vectors else None
    cached = _cached(args, records) if args.vector_cache and vectors is None else None
    limits = {"hub_limit": args.max_hub_surface_issues, "guarded_pairs": args.explain_hub_guard} if hasattr(args, "explain_hub_guard") else {}
    options = Options(tuple(args.status or ACTIVE_STATUSES), args.include_epics, getattr(args, "max_batch_size", 9), getattr(args, "code_surfaces", True), include_ephemeral=args.include_ephemeral, **limits)
    review = Review(snapshot, records, policy_of(args), options, cached.vectors if cached else vectors, _repository(args, spark), _scope(args, spark, snapshot, records))
    review.cache = {"hits": cached.hits, "encoded": cached.encoded} if cached else None
    return review


def _cached(args: argparse.Namespace, records):
    """Vectors of the records by way of the cache."""
    from quillon.operators.vectors import hashing_vectors
    from quillon.plans.review import BUCKETS, texts
    from quillon.sources.vector_cache import Model, cached_vectors

    return cached_vectors(texts(records), lambda missing: hashing_vectors(missing, BUCKETS), Model("hashing", "1", BUCKETS), args.vector_cache)


def _repository(args: argparse.Namespace, spark):
    """What the given files tell of the code: a path a line, porcelain worktrees, changes as JSON lines."""
    from pyspark.sql import functions as F

    from quillon.operators import surfaces
    from quillon.plans.review import Repository

    if not hasattr(args, "worktree"):
        return Repository()
    if args.worktree and not args.worktree_list:
        raise ValueError("--worktree needs --worktree-list")
    given = [tuple(part.strip() for part in w.partition("=")) for w in args.worktree]
    if not all(issue and path for issue, _, path in given):
        raise ValueError("a worktree mapping is not ID=PATH")
    if len({issue for issue, _, _ in given}) < len(given):
        raise ValueError("a worktree is mapped twice")
    files = spark.read.text(args.repository_files).select(F.col("value").alias("path")) if args.repository_files else None
    trees = surfaces.worktrees(spark.read.text(args.worktree_list, lineSep="\n\n")) if args.worktree_list else None
    changes = spark.read.schema("worktree string, path string, kind string").json(args.changed_paths) if args.changed_paths else None
    mappings = surfaces.mappings(spark.createDataFrame([(w,) for w in args.worktree], "value string")) if args.worktree else None
    return Repository(files, trees, changes, mappings, args.revision, "handed-over" if files is not None or trees is not None else "unavailable")


def _scope(args: argparse.Namespace, spark, snapshot, records):
    """Ids of the records that changed, of an incremental run; None for a whole one."""
    from pyspark.sql import functions as F

    from quillon.operators import incremental

    if getattr(args, "since", None):
        if spark.range(1).select(incremental.parse_rfc3339(F.lit(args.since)).isNull()).first()[0]:
            raise ValueError("--since is no time with a zone")
        return incremental.scope_since(records, args.since).filter("state = 'changed'").select("id")
    if getattr(args, "checkpoint", None):
        prior = sinks.read_checkpoint(spark, args.checkpoint, snapshot.workspace_id, _now())
        return incremental.compare(incremental.checkpoint(_plain_state(records), STATE), prior).filter("state = 'changed'").select("id")
    return None


def _now() -> str:
    return datetime.now(UTC).strftime("%Y-%m-%dT%H:%M:%SZ")


def run_id() -> str:
    """When the run was, and eight digits that part it from others of that second."""
    return f"{datetime.now(UTC):%Y%m%dT%H%M%SZ}-{uuid.uuid4().hex[:8]}"


def _plain_state(records):
    """Records with labels and links as texts, for fingerprints."""
    from pyspark.sql import functions as F

    links = F.array_join(F.transform("links", lambda p: F.concat_ws(":", p["target_id"], p["relationship_type"])), ",")
    return records.withColumns({"labels": F.array_join("labels", ","), "links": links})


def _save_checkpoint(args: argparse.Namespace, review) -> None:
    from quillon.operators import incremental

    if getattr(args, "write_checkpoint", None):
        path = sinks.outside(args.write_checkpoint, review.snapshot.workspace_path)
        sinks.write_checkpoint(incremental.checkpoint(_plain_state(review.records), STATE), str(path), review.snapshot.workspace_id, _now())


def _reports(args: argparse.Namespace, review) -> tuple[str, dict, str, list[tuple[dict, str]]]:
    from quillon.plans import review as R

    if args.command == "neighbors":
        report = R.neighbors_report(review, args.issue_id, args.limit, args.include_closed)
        return "neighbors", report, markdown.neighbors(report), []
    if args.command == "collisions":
        report = R.collisions_report(review)
        return "collisions", report, markdown.collisions(report), []
    report = R.sweep_report(review)
    if args.command == "triage":
        short = R.triage_report(report)
        return "triage", short, markdown.triage(short), [] if args.output else _batches(report)
    return "report", report, markdown.sweep(report), _batches(report)


def _batches(report: dict) -> list[tuple[dict, str]]:
    out = []
    for b in report["batches"]:
        ids = set(b["members"].split(","))
        own = {**{k: report[k] for k in ("schema_version", "policy", "snapshot")}, "report_type": "batch", **b, "candidates": [c for c in report["candidates"] if ids & {c["issue_id"], c["related_issue_id"]}]}
        out.append((own, markdown.batch(own)))
    return out


def capabilities() -> dict:
    return {"document_type": "quillon-capabilities", "protocol_version": 1, "role": "producer", "schema_versions": [1], "report_types": list(REPORTS), "capabilities": list(ABILITIES), "required_capabilities": [ABILITIES[0]]}


def readiness(spark) -> dict:
    """One text is embedded; no record is read."""
    from quillon.plans.review import BUCKETS, TEXTS, hashing_vectors

    probe = spark.createDataFrame([("probe", "ready", *[""] * (len(TEXTS) - 1))], ", ".join(f"{c} string" for c in ("id", *TEXTS)))
    row = hashing_vectors(probe).first()
    return {"readiness_version": 1, "model_id": "hashing", "vector_dimension": len(row.v), "ready": len(row.v) == BUCKETS, "corpus_loaded": False}


def doctor(args: argparse.Namespace) -> dict:
    """Whether each input can be used; the worst state is the whole's."""

    def check(path: str | None, needed: bool, what: str) -> dict:
        if not path:
            return {"status": "blocked" if needed else "attention", "detail": f"no {what} is named"}
        there = "://" in path or Path(path).exists()
        return {"status": "ready" if there else "blocked", "detail": f"{what} {'found' if there else 'not found'}"}

    vectors = check(args.vectors, False, "vector table") if args.vectors else {"status": "ready", "detail": "hashing vectors are made"}
    checks = {"source": check(args.list, True, "list"), "workspace": check(args.context, True, "context"), "export": check(args.export, False, "export"), "embedding": vectors}
    worst = max((c["status"] for c in checks.values()), key=("ready", "attention", "blocked").index)
    return {"doctor_version": 1, "status": worst, "read_only": True, "corpus_loaded": False, **checks}


def guard(arguments: list[str]) -> list[str]:
    """Arguments that an outside caller may pass: a known report, no writing option, JSON."""
    rest, command = iter(arguments), None
    for a in rest:
        if a.split("=")[0] in WRITERS:
            raise ValueError("options that write files are refused")
        if a in TAKES_VALUE:
            if next(rest, None) is None:
                raise ValueError("an option has no value")
        elif command is None and not a.startswith("-"):
            command = a
    if command not in GUARDED:
        raise ValueError("only " + ", ".join(GUARDED) + " may be asked for")
    return [*arguments] if "--json" in arguments else [*arguments, "--json"]


def _show(payload: dict, as_json: bool) -> None:
    sys.stdout.write(sinks.to_json(payload) if as_json else "".join(f"{k}: {v}\n" for k, v in payload.items()))


def run(argv: list[str] | None = None, spark=None) -> int:
    args = parser().parse_args(argv)
    if args.command == "capabilities":
        _show(capabilities(), args.as_json)
        return 0
    if args.command == "doctor":
        found = doctor(args)
        _show(found, args.as_json)
        return 2 if found["status"] == "blocked" else 0
    try:
        policy_of(args)
        spark = spark or _spark(args.master)
        if args.command == "readiness":
            _show(readiness(spark), args.as_json)
            return 0
        review = _review(args, spark)
        name, report, text, batches = _reports(args, review)
        report = {**report, "run_id": run_id(), **({"vector_cache": review.cache} if review.cache else {})}
        folder, file, form = sinks.output_paths(args.output, args.output_dir, "", "")
        if args.output is None and args.output_dir is None:
            sys.stdout.write(sinks.to_json(report) if args.as_json else text)
        elif file is not None:
            sinks.write_text(file, sinks.to_json(report) if form == "json" else text)
        else:
            sinks.report_folder(folder, name, report, text, batches)
        _save_checkpoint(args, review)
        return sinks.exit_code(bool(review.snapshot.divergence), args.fail_on_divergence)
    except (ValueError, OSError) as error:
        sys.stderr.write(f"quillon: {str(error)[:500]}\n")
        return 2
