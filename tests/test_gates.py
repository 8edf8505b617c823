"""Decisions about evidence and answers, each rule by hand."""

from corpusmill.operators import gates as G

TASKS = "task_id int, answerability string, project_id string, required array<string>, forbidden array<string>"
ITEMS = "task_id int, place int, ref string, status string, project_id string"


def test_evidence(spark):
    tasks = [
        (1, None, None, None, None), (2, "unknown", "p", [], []), (3, "conflicting", "p", [], []), (4, "answerable", "p", ["a/x.md"], ["a/bad.md"]), (5, "answerable", "p", ["a/z.md"], []),
        (6, "answerable", "p", [], []), (7, "Insufficient ", "", [], []), (8, "answerable", "", [], []), (9, "answerable", "", ["x"], []), (10, "answerable", "p", [], []),
    ]
    items = [
        (1, 0, "", None, None), (2, 0, "a/x.md", "active", "p"), (4, 0, "a/x.md#h:ch1", "active", "p"), (4, 1, "a/bad.md#q", "active", "p"), (4, 2, "a/y.md", "Archived", "p"), (4, 3, "a/w.md", "active", "q"), (4, 4, "", "active", "p"),
        (5, 0, "a/x.md", "active", "default"), (6, 0, "a/x.md", "revoked", "p"), (6, 1, "a/y.md", "revoked", "p"), (8, 0, "a/x.md", "active", "any"), (9, 0, "", "active", ""),
    ]
    got = {r.task_id: (r.status, r.allowed, r.reasons) for r in G.evidence_gate(spark.createDataFrame(tasks, TASKS), spark.createDataFrame(items, ITEMS)).collect()}
    assert got == {
        1: ("answerable", [], []), 2: ("insufficient", [], ["answerability_absent"]), 3: ("conflicting", [], ["conflicting_evidence"]),
        4: ("answerable", ["a/x.md#h:ch1"], ["forbidden_ref", "inactive:archived", "scope_denied", "missing_ref"]), 5: ("insufficient", ["a/x.md"], ["required_ref_missing"]),
        6: ("insufficient", [], ["inactive:revoked"]), 7: ("insufficient", [], ["answerability_insufficient"]), 8: ("answerable", ["a/x.md"], []), 9: ("insufficient", [], ["missing_ref"]), 10: ("insufficient", [], ["no_usable_evidence"]),
    }


def test_answers(spark):
    refs = ["wiki/a b.md#h:ch00000001", "wiki/c.md"]
    cases = [
        ("so it is [[a b]]", refs, "answerable", "", ("answerable", ["wiki/a b.md#h:ch00000001"], "", False)),
        ("as wiki/c.md says", refs, "answerable", "", ("answerable", ["wiki/c.md"], "", False)),
        ("```\n[[nowhere]]\n```\n[[c|that]]", refs, "answerable", "sufficient", ("answerable", ["wiki/c.md"], "", False)),
        ("[[nowhere]] and [[c]]", refs, "answerable", "", ("insufficient", ["wiki/c.md"], "citation_out_of_scope", False)),
        ("资料不足，无法回答 [[c]]", refs, "answerable", "", ("insufficient", ["wiki/c.md"], "explicit_abstention", True)),
        ("no source at all [[{ref}]] [[link]]", refs, None, "", ("insufficient", [], "citation_missing", False)),
        ("rag_search([[nowhere]]) [[c]]", refs, "answerable", "reformulate", ("insufficient", [], "assessment_requires_abstention", False)),
        ("x", [], "answerable", None, ("insufficient", [], "no_usable_evidence", False)), ("x", None, "scope_denied", "", ("insufficient", [], "scope_denied", False)),
        (None, refs, "conflicting", "", ("conflicting", [], "conflicting_evidence", False)), ("x", refs, "absent", "", ("insufficient", [], "answerability_absent", False)),
    ]
    frame = spark.createDataFrame([(i, *c[:4]) for i, c in enumerate(cases)], "task_id int, answer string, refs array<string>, answerability string, assessment string")
    got = [(r.status, r.cited, r.reason, r.abstained) for r in G.answer_gate(frame).orderBy("task_id").collect()]
    assert got == [c[4] for c in cases]
    partial = spark.createDataFrame([(1, "只能概括 [[c]]", refs, "answerable", "insufficient"), (2, "all of it [[c]]", refs, "answerable", "insufficient")], frame.schema)
    assert [(r.status, r.reason) for r in G.answer_gate(partial, allow_partial=True).orderBy("task_id").collect()] == [("answerable", "bounded_partial"), ("insufficient", "assessment_requires_abstention")]
