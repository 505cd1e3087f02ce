"""Cursor pages through the data source, with transports that serve them from memory."""

import json

import pytest
from pyspark.errors import PySparkException

from quillon.sources import connection, host_pages
from quillon.sources.trackers import SourceError

ISSUES, RELATIONS = "query Issues($teamId: String!, $first: Int!, $after: String) { issues }", "query Relations { issueRelations }"


def issue(k):
    state = ["started", "completed", "backlog"][k % 3]
    return {"identifier": f"ENG-{k}", "title": f"Issue {k}", "description": None, "state": {"type": state}, "priority": k % 5, "updatedAt": "2026-01-01T00:00:00Z", "labels": {"nodes": [{"name": "bug"}], "pageInfo": {"hasNextPage": False}}, "parent": None}


def page(nodes, after):
    return {"nodes": nodes, "pageInfo": {"hasNextPage": after is not None, "endCursor": after}}


def served(query, variables):
    """Seven issues and two relations in pages of the asked size."""
    if "issueRelations" in query:
        rows = [{"issue": {"identifier": "ENG-1"}, "relatedIssue": {"identifier": "ENG-2"}, "type": "blocks"}, {"issue": {"identifier": "ENG-3"}, "relatedIssue": {"identifier": "X-9"}, "type": "related"}]
        name = "issueRelations"
    else:
        assert variables["teamId"] == "team"
        rows, name = [issue(k) for k in range(7)], "issues"
    at, size = int(variables["after"] or 0), variables["first"]
    return {name: page(rows[at : at + size], str(at + size) if at + size < len(rows) else None)}


def standing(query, variables):
    return {"issues": page([issue(0)], "same")}


def nameless(query, variables):
    return {"issues": page([issue(0)], "")}


def empty(query, variables):
    return {"issues": {"nodes": None}}


def named(name):
    return f"tests.test_connection:{name}"


@pytest.mark.parametrize("size", [1, 3, 7, 50])
def test_follows_cursors(spark, size):
    rows = connection.connection(spark, "issues", ISSUES, named("served"), {"teamId": "team"}, size).collect()
    assert [json.loads(r.node)["identifier"] for r in rows] == [f"ENG-{k}" for k in range(7)]


@pytest.mark.parametrize(("transport", "told"), [("standing", "did not advance"), ("nameless", "no end cursor"), ("empty", "no issues connection")])
def test_refuses_broken_pages(spark, transport, told):
    with pytest.raises(PySparkException, match=told):
        connection.connection(spark, "issues", ISSUES, named(transport))


def test_refuses_wrong_options():
    good = {"connection": "issues", "query": ISSUES, "transport": named("served")}
    for wrong in ({"query": "mutation { x }"}, {"connection": ""}, {"transport": ""}, {"pageSize": "-1"}, {"variables": "[1]"}):
        with pytest.raises(SourceError):
            connection.ConnectionReader({**good, **wrong})
    with pytest.raises(SourceError):
        connection.transport_of("nowhere")


def test_same_records_as_page_files(spark, tmp_path):
    live = connection.HostConnections(spark, "o", "team", {"issues": ISSUES, "issueRelations": RELATIONS}, named("served"), 3)
    paths = {}
    for name, query in (("issues", ISSUES), ("issueRelations", RELATIONS)):
        after, paths[name] = None, []
        while True:
            data = served(query, {"teamId": "team", "first": 2, "after": after})
            path = tmp_path / f"{name}-{len(paths[name])}.json"
            path.write_text(json.dumps(data))
            paths[name].append(str(path))
            after = data[name]["pageInfo"]["endCursor"]
            if after is None:
                break
    files = host_pages.HostPages(spark, "o", "team", paths["issues"], paths["issueRelations"])
    (one, rows), (two, want) = live.load(), files.load()
    assert one == two and one.warnings
    assert sorted(map(str, rows.collect())) == sorted(map(str, want.collect()))
