"""What stricter thresholds bring in through caps, on hand-made queues."""

from quillon.model import ECHO, OVERLAP, CandidatePolicy
from quillon.operators.selection import Chosen, cap_replacements, replacements


def over(a, b):
    return Chosen(OVERLAP, a, b, "overlap")


def echo(a, b):
    return Chosen(ECHO, a, b, "echo")


def test_freed_place_of_a_record():
    policy = CandidatePolicy(max_per_issue=1)
    (row,) = cap_replacements([over("a", "b")], [over("b", "c")], [over("a", "b"), over("b", "c")], [over("b", "c")], policy)
    assert row["governing_cap"] == "max-candidates-per-issue" and row["displaced"] == [over("a", "b").name]
    assert [(c["event"], c["resource"]) for c in row["causal_chain"]] == [("qualification-removed", "semantic-issue:b"), ("selection-admitted", "semantic-issue:b")]


def test_chain_over_a_displaced_echo():
    policy = CandidatePolicy(max_echoes_per_target=1)
    reference, strict = [echo("a", "x"), echo("b", "y")], [echo("a", "y")]
    (row,) = cap_replacements(reference, strict, [*reference, *strict], [echo("b", "y"), *strict], policy)
    assert row["governing_cap"] == "max-echoes-per-target"
    assert row["causal_chain"][0]["candidate_id"] == echo("a", "x").name and row["causal_chain"][-1]["event"] == "selection-admitted"


def test_no_cap_no_row():
    assert cap_replacements([over("a", "b")], [over("c", "d")], [over("a", "b")], [], CandidatePolicy()) == []


def test_tables_give_the_same_as_lists(spark):
    policy = CandidatePolicy(max_per_issue=1, max_total=2)
    reference = [(over("a", "b"), "admitted"), (over("c", "d"), "admitted"), (over("b", "c"), "dropped"), (over("e", "f"), "dropped"), (over("g", "h"), "dropped")]
    strict = [(over("c", "d"), "admitted"), (over("e", "f"), "admitted"), (over("b", "c"), "dropped")]
    pick = lambda rows, all_=False: [c for c, d in rows if all_ or d == "admitted"]
    want = cap_replacements(pick(reference), pick(strict), pick(reference, True), pick(strict, True), policy)
    frame = lambda rows: spark.createDataFrame([(c.kind, c.issue_id, c.related_issue_id, c.lane, d) for c, d in rows], "kind string, issue_id string, related_issue_id string, lane string, decision string")
    got = replacements(frame(reference), frame(strict), policy).collect()
    assert want and [(r.candidate_id, r.governing_cap, list(r.displaced), [c.asDict() for c in r.causal_chain]) for r in got] == [
        (w["candidate_id"], w["governing_cap"], w["displaced"], w["causal_chain"]) for w in want
    ]
