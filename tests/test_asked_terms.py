"""Terms of documents that questions ask for: the same as all terms, cut by bytes in the tasks, and lines of items without a shuffle of all lines."""

import pyarrow as pa
from pyspark.sql import functions as F

from corpusmill.functions.text import index_tokens
from corpusmill.operators import ranking
from corpusmill.operators.lexical import query_tokens

TEXTS = [
    "Plain words, twice words", "", None, "a.b a..b a.:b -x- x: _q_", "READ.MD notes.md x.markdown md .md a.md.md", "中文檢索a中 文 豈更 あ中文", "é.a b.é naïve", "a.", "b", ":c", "中", "文", "😀中😀 x",
    "tail-", "head", "1.2:3-4_5", "line\nline two\r\nA.\nB",
]
ASKED = [(1, "plain words READ.md x a b c head"), (2, "中文檢索 notes line.two line two 1.2:3-4_5"), (3, "nowhere")]


def test_tokens_are_those_of_index_tokens(spark):
    rows = spark.createDataFrame(list(enumerate(TEXTS)), "i int, text string").select("i", index_tokens(F.col("text")).alias("t")).collect()
    texts = pa.array(["skipped é.", *TEXTS]).slice(1)
    places, tokens = ranking.text_tokens(texts)
    got = {i: set() for i in range(len(TEXTS))}
    for i, t in zip(places.tolist(), tokens.to_pylist(), strict=True):
        got[i].add(t)
    assert got == {r.i: set(r.t) for r in rows}


def test_same_sums_as_with_all_terms(spark, monkeypatch):
    monkeypatch.setattr(ranking, "STEP_BYTES", 20)
    for more in ([], [(3, "words x", "head"), (None, "a b", "c"), (None, "a", "b")]):
        rows = [(i, t, (t or "").split("\n")[0]) for i, t in enumerate(TEXTS)] + more
        docs = spark.createDataFrame(rows, "doc_id long, content string, title string").repartition(3)
        tokens = query_tokens(spark.createDataFrame(ASKED, "query_id long, text string"))
        fields = {"content": 1.0, "title": 3.0}
        few, every = ranking.asked_terms(docs, fields, tokens), ranking.document_terms(docs, fields)
        held = lambda terms: sum(len(r.terms) for r in terms.collect())
        assert held(few) < held(every)
        for column in ("weights", "content"):
            got = [sorted(map(str, ranking.best_documents(t, tokens, 8, column).collect())) for t in (few, every)]
            assert got[0] == got[1] and got[0]


def test_lines_of_documents_are_not_shuffled(spark):
    from corpusmill.plans import evaluations

    seen = []
    keep, evaluations.stored = evaluations.stored, lambda df, label: seen.append(df) or df
    try:
        evaluations.qrels(spark, "/root/testdata/sf0.001").collect()
    finally:
        evaluations.stored = keep
    plan = seen[0]._jdf.queryExecution().optimizedPlan().toString()
    below = plan[plan.index("Join") :]
    scan = below.index("doc_id")
    assert "Aggregate" not in "".join(line for line in below[:scan].splitlines() if "item_id" not in line and "task_id" not in line)
