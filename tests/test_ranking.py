"""Best documents of many questions: what leaves a task, ties, ids with several rows, null ids, blocks."""

from collections import defaultdict
from types import SimpleNamespace

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from corpusmill.operators import ranking
from corpusmill.operators.lexical import query_tokens

N, K = 600, 5
WORDS = [(i, " ".join(f"w{j}" for j in range(1, 12) if (i * j) % 7 < 4)) for i in range(N)]
ROWS = [(*row, row[1].split(" ")[0]) for row in WORDS] + [(3, "w1 w99", "w99"), (None, "w1 w2", "w2")]
ASKED = [(q, f"w{q % 11 + 1} w{q % 5 + 1} w{q % 3 + 1}") for q in range(40)] + [(7, "w2 w9"), (90, "nowhere"), (91, "w99")]


def expected() -> dict:
    weight, held = defaultdict(float), defaultdict(set)
    for d, text, title in ROWS:
        for w, tokens in ((1.0, text.split()), (3.0, [title])):
            for t in set(tokens):
                weight[d, t] += w
                held[t].add(d)
    score = defaultdict(lambda: defaultdict(float))
    for q, text in ASKED:
        for t in set(text.split()):
            for d in held[t]:
                score[q][d] += weight[d, t]
    order = lambda r: (-r[1], r[0] is None, r[0] or 0)
    return {q: sorted(found.items(), key=order)[:K] for q, found in score.items()}


@pytest.mark.parametrize("terms", [500_000, 7])
def test_as_one_loop_over_all(spark, monkeypatch, terms):
    monkeypatch.setattr(ranking, "BLOCK_TERMS", terms)
    docs = spark.createDataFrame(ROWS, "doc_id long, content string, title string").repartition(3)
    asked = spark.createDataFrame(ASKED, "query_id long, text string")
    found = ranking.best_documents(ranking.document_terms(docs, {"content": 1.0, "title": 3.0}), query_tokens(asked), K)
    got = defaultdict(list)
    for r in found.orderBy("query_id", "rank").collect():
        got[r.query_id].append((r.doc_id, r.score))
    assert dict(got) == expected()


def test_only_the_best_rows_are_shuffled(spark):
    docs = spark.range(20_000).select(F.col("id").alias("doc_id"), F.lit("a b c").alias("content")).repartition(2)
    asked = spark.range(50).select(F.col("id").alias("query_id"), F.lit("a b").alias("text"))
    found = ranking.best_documents(ranking.document_terms(docs, {"content": 1.0}), query_tokens(asked), K)
    assert [r.doc_id for r in found.where("query_id = 9").orderBy("rank").collect()] == list(range(K))
    python = [line for line in found._jdf.queryExecution().executedPlan().toString().splitlines() if "MapInArrow" in line]
    assert python and "Join" not in found._jdf.queryExecution().executedPlan().toString()


def test_small_steps_give_the_same(monkeypatch):
    asked = [SimpleNamespace(query_id=q, terms=[q % 5, 7 + q % 3], weights=[1.0, 2.0], times=[1, 1]) for q in range(30)]
    lists = [[t for t in range(10) if (d * t) % 4 < 3] for d in range(200)]
    batch = pa.RecordBatch.from_pydict({"doc_id": list(range(200)), "terms": lists, "weights": [[1.0 + t % 2 for t in own] for own in lists]})

    def held(sums):
        monkeypatch.setattr(ranking, "SUMS", sums)
        block = ranking.Block(asked)
        best = ranking.Best(30, K, False)
        ranking.score_batch(batch, block, best, None)
        best.judge()
        return [c.tolist() for c in best.held]

    assert held(50) == held(2_000_000) and len(held(50)[0]) == 30 * K
