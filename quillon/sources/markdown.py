"""Reports as Markdown for people; every text that comes from a record is escaped."""

from __future__ import annotations

NOTICE = "Read-only review: nothing in the tracker was changed. Every row is a lead to check, not a finding."
LANES = ("dependency", "echo", "overlap")


def escape(value) -> str:
    return "" if value is None else str(value).replace("|", "\\|").replace("\r\n", " ").replace("\n", " ")


def _table(head: list[str], rows: list[list]) -> list[str]:
    if not rows:
        return ["None."]
    return ["| " + " | ".join(head) + " |", "|" + "-|" * len(head), *["| " + " | ".join(map(escape, r)) + " |" for r in rows]]


def _open(title: str, report: dict) -> list[str]:
    out = [f"# {title}", "", f"> {NOTICE}", ""]
    if report.get("analysis_fingerprint"):
        out += [f"Analysis fingerprint: `{report['analysis_fingerprint']}`", ""]
    if report.get("warnings"):
        out += ["## Warnings", "", *[f"- {escape(w)}" for w in report["warnings"]], ""]
    return out


def _lanes(report: dict) -> list[str]:
    lanes = report.get("lane_summary", {})
    return _table(["lane", "admitted", "qualified", "omitted"], [[k, lanes[k]["admitted"], lanes[k]["qualified"], lanes[k]["omitted"]] for k in LANES if k in lanes])


def _leads(rows: list[dict]) -> list[str]:
    shown = lambda r: ", ".join((r["shared_paths"] or [])[:3] or r["shared_modules"] or [])
    return _table(["record", "record", "kind", "confidence", "intent", "surfaces"], [[r["issue_id"], r["related_issue_id"], r["kind"], r["confidence"], r["edit_intent"], shown(r)] for r in rows])


def triage(report: dict) -> str:
    people = report["population"]
    rows = [[c["lane"], c["issue_id"], c["related_issue_id"], f"{c['similarity']:.3f}", c["likely_action"], c["what_to_verify"]] for c in report["candidates"]]
    out = _open("Triage packet", report)
    out += [f"{len(rows)} candidates, {len(report['collisions'])} code leads, {people['no_signal']} records without signal, {people['excluded']} excluded.", "", *_lanes(report), ""]
    out += ["## Candidates", "", *_table(["lane", "record", "related", "similarity", "action", "check"], rows), "", "## Code leads", "", *_leads(report["collisions"]), ""]
    return "\n".join(out)


def sweep(report: dict) -> str:
    rows = [
        [c["position"], c["lane"], c["issue_id"], c["related_issue_id"], f"{c['similarity']:.3f}", c["admission_reason"], c["pattern"], "; ".join(c["counterevidence"]), c["what_to_verify"]]
        for c in report["candidates"]
    ]
    out = [*_open("Sweep report", report), *_lanes(report), "", "## Candidates", ""]
    out += _table(["#", "lane", "record", "related", "similarity", "admitted by", "pattern", "against", "check"], rows)
    out += ["", "## Batches", "", *_table(["batch", "size", "members"], [[b["batch"], b["size"], b["members"]] for b in report["batches"]]), "", "## Code leads", "", *_leads(report["collisions"]), ""]
    return "\n".join(out)


def batch(report: dict) -> str:
    rows = [[c["lane"], c["issue_id"], c["related_issue_id"], f"{c['similarity']:.3f}", c["why_surfaced"]] for c in report["candidates"]]
    return "\n".join([*_open(f"Batch {report['batch']}", report), f"Members: {escape(report['members'])}", "", *_table(["lane", "record", "related", "similarity", "why"], rows), ""])


def collisions(report: dict) -> str:
    return "\n".join([*_open("Code collisions", report), f"{report['hubs']} hub surfaces were left out.", "", *_leads(report["collisions"]), ""])


def neighbors(report: dict) -> str:
    rows = [[n["rank"], n["candidate_id"], f"{n['score']:.3f}", n["status"], n["title"]] for n in report["neighbors"]]
    return "\n".join([*_open(f"Neighbours of {escape(report['issue_id'])}", report), *_table(["rank", "record", "similarity", "status", "title"], rows), ""])
