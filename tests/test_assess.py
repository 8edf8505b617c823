"""Kinds of questions, references, ranges, samples and coverage on hand-made rows."""

import random
import re

from pyspark.sql import functions as F

from corpusmill.functions import queries as Q
from corpusmill.operators import evaluation as E
from corpusmill.operators import governance as G
from corpusmill.operators import graph, sessions
from corpusmill.operators.chunking import line_kind
from corpusmill.operators.similarity import coverage_pairs, jaccard_pairs


def column(spark, values, make):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, t string")
    return [r.x for r in rows.select("i", make(F.col("t")).alias("x")).orderBy("i").collect()]


def test_kinds_of_questions(spark):
    cases = {
        "": "empty", None: "empty", "what does vault_search do": "identifier", "open BV1xx411c7mD": "identifier", "read a/note.md": "identifier", "call f(x, y) now": "identifier", "error 404": "identifier", "and this one?": "followup",
        "哪些没有标签": "negative", "pages without any tag in the whole vault": "negative", "compare the north lake with the south lake": "multi_hop", "why? and when?": "multi_hop",
        "how does the index keep its rows": "natural",
    }
    assert column(spark, list(cases), Q.question_kind) == list(cases.values())
    assert [row[0] for row in spark.createDataFrame([("x" * 40 + " this", "before"), ("x" * 40 + " this", " ")], "t string, c string").select(Q.question_kind(F.col("t"), F.col("c"))).collect()] == ["followup", "natural"]


def test_entities_are_those_of_python(spark):
    """Word bounds and case by Unicode, as in Python's patterns."""
    texts = [r.text for name in ("conversations", "benchmark") for r in spark.read.parquet(f"/root/testdata/sf0.001/{name}.parquet").select("text").collect()]
    texts += ["Use RRF_K and rrf_k, v2.1 of a.b", "用RRF_K吧 第3章 12% 5月", "größe SS-x éAB AB-é", "a/b c.md\nf(x) g(y)) av12 EP7", None, "", "x" * 50 + " " + " ".join(f"n_{i}" for i in range(60))]

    def plain(text):
        found = re.findall(Q.IDENTIFIER, text or "", re.I) + re.findall(Q.ACRONYM, text or "") + re.findall(Q.NUMBER, text or "")
        out = {}
        for w in found:
            out.setdefault(w.strip().lower(), w.strip())
        return [w for k, w in out.items() if k][: Q.MOST_KEPT]

    assert column(spark, texts, Q.kept_entities) == [plain(t) for t in texts]


def test_references_of_one_entry(spark):
    pairs = [
        ("a/x.md", "a/x.md", True), ("a/x.md", "a/x.md#h:ch00000001", True), ("a/x.md#h:ch1", "a/x.md#h", True), ("x", "a/x.md#h", True), ("X", "a/x.md", False),
        ("b/x.md", "a/x.md", False), ("x.MD", "a/x.md", True), ("", "a/x.md", False), ("a/x", "a/x.md", False),
    ]
    rows = spark.createDataFrame([(i, *p) for i, p in enumerate(pairs)], "i int, e string, a string, want boolean")
    assert [r.x == r.want for r in rows.select(Q.same_reference(F.col("e"), F.col("a")).alias("x"), "want").collect()] == [True] * len(pairs)


def test_logs_are_cut_by_tokens(spark):
    turns = spark.createDataFrame([(1, i, n) for i, n in enumerate([150, 60, 10, 180, 400, 5])] + [(2, 0, 1)], "c int, o int, n int")
    got = [(r.c, r.o, r.seq) for r in sessions.folded_ranges(turns, "c", "o", "n", 200).orderBy("c", "o").collect()]
    assert got == [(1, 0, 1), (1, 1, 1), (1, 2, 2), (1, 3, 2), (1, 4, 3), (1, 5, 5), (2, 0, 1)]


def test_whole_files_within_a_limit(spark):
    rng = random.Random(1)
    for limit in (0, 7, 40, 90, 500):
        files = [(i, rng.choice("abc"), rng.randrange(1, 9)) for i in range(30)]
        first = {c: min((s, i) for i, k, s in files if k == c) for c in "abc"}
        want, used = [], 0
        for c in sorted(first):
            used += first[c][0]
            want += [first[c][1]] if used <= limit else []
        left = limit - sum(s for i, _, s in files if i in want)
        for s, i in sorted((s, i) for i, _, s in files if i not in want):
            if s > left:
                break
            want, left = [*want, i], left - s
        frame = spark.createDataFrame(files, "i long, c string, s long")
        assert sorted(r.i for r in sessions.whole_sample(frame, "c", "s", "i", limit).collect()) == sorted(want)


def test_coverage_equals_all_pairs(spark):
    rng = random.Random(3)
    sets = [(i, rng.sample(range(14), rng.randint(0, 9))) for i in range(50)]
    frame = spark.createDataFrame(sets, "id int, tokens array<int>")
    got = {(r.id, r.other): r.coverage for r in coverage_pairs(frame, 0.72).collect()}
    want = {(a, b): round(len(set(x) & set(y)) / len(x), 6) for a, x in sets for b, y in sets if a != b and x and len(set(x) & set(y)) >= 0.72 * len(x)}
    assert got == want
    stars = {(r.left_id, r.right_id) for r in jaccard_pairs(frame, 0.7, copies="first").collect()}
    firsts = {i: min(j for j, y in sets if set(y) == set(x)) for i, x in sets}
    pairs = {(a, b) for a, x in sets for b, y in sets if a < b and x and len(set(x) & set(y)) > 0.7 * len(set(x) | set(y))}
    assert stars == {(a, b) for a, b in pairs if firsts[a] == a and (firsts[b] == b or firsts[b] == a)}


def test_gates_block_on_missing_figures(spark):
    figures = spark.createDataFrame([(0.5, None)], "a double, b double")
    assert [tuple(r) for r in E.gate(figures, {"x": "a >= 0.5", "y": "b >= 0"}).collect()] == [("x", True), ("y", False)]
    answers = spark.createDataFrame([(True, True), (True, False), (False, True), (False, False), (False, False)], "answerable boolean, answered boolean")
    assert tuple(E.answer_figures(answers).first()) == (5, 0.333333, 0.5)


def test_suspicious_texts(spark):
    bad = ["Ignore all previous notes", "please IGNORE instructions", "忽略之前的指令", "忽略规则", "remember this password", "记住密码", "api_key = 3", "Access-Token: x"]
    good = ["the system is fine", "tokens are counted", "remember the milk", "", None, "ignore him", "a cookie jar", "disregard the noise"]
    assert column(spark, bad, G.suspicious) == [True] * len(bad) and column(spark, good, G.suspicious) == [False] * len(good)


def test_kinds_of_lines(spark):
    cases = {
        "# a": "heading", "####### a": "paragraph", " # a": "paragraph", "#a": "paragraph", "| a | b |": "table", "> note": "callout", "- a": "list", "  * a": "list", "12. a": "list",
        "3) a": "list", "1.5 a": "paragraph", "-a": "paragraph", "": "blank", "   ": "blank", "text": "paragraph",
    }
    assert column(spark, list(cases), line_kind) == list(cases.values())


def test_links_between_brackets(spark):
    notes = spark.createDataFrame([("n", "[[a#h|x]] [[b|y]] [[c]] [[#h]] [[d [[e]] f]] [g]] [[open")], "path string, text string")
    assert [r.link for r in graph.wikilinks(notes).collect()] == ["a", "b", "c", "e"]


def test_variants_of_questions(spark):
    from corpusmill.operators import selection as S

    cases = {
        "什么是向量索引，如何更新它的内容": None, "BV1xx411c7mD": [], "哪些没有标签": [], "": [], None: [], "north lake": ["north", "lake"], "North north": ["North"],
        "how does the agent keep Memory notes": ["Memory", "agent", "notes", "does", "keep"], "处理视频之前要注意核对什么": None,
    }
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(cases)], "query_id int, text string")
    got = {i: [] for i in range(len(cases))}
    for r in S.query_variants(rows).orderBy("query_id", "place").collect():
        got[r.query_id].append(r.variant)
    for i, want in enumerate(cases.values()):
        if want is not None:
            assert got[i] == want, (i, got[i])
    assert got[0][0] == "向量索引，如何更新它的内容" and got[0][1:3] == ["如何更新它的内容", "向量索引"] and len(got[0]) == 5 and not any("的" in v for v in got[0][4:] if len(v) == 2)
    assert got[8][:3] == ["B站视频处理前核对 bili_meta", "收件箱 B站处理前先核对", "视频任务处理前核对元信息"] and len(got[8]) <= 5
