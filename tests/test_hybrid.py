"""Routes, their gates and what is shown, on a corpus of a few rows."""

import pytest
from pyspark.sql import functions as F

from corpusmill.operators import hybrid
from corpusmill.operators.lexical import query_tokens

DOCS = {1: "red fox jumps", 2: "red fox", 3: "blue whale", 4: "green tree stands tall"}
VECTORS = {1: [1.0, 0.0], 2: [0.8, 0.6], 3: [0.0, 1.0], 4: [-1.0, 0.0]}
QUESTIONS = [
    (10, "red fox", [1.0, 0.0]), (11, "red fox 哪些", [1.0, 0.0]), (12, "zzname123", [1.0, 0.0]), (13, "blue mystery", [0.0, 1.0]), (14, "red fox", None), (15, "green", [0.6, 0.8]),
]


@pytest.fixture(scope="module")
def corpus(spark):
    docs = spark.createDataFrame(list(DOCS.items()), "doc_id long, text string")
    posting = docs.select("doc_id", F.explode(F.split("text", " ")).alias("token"), F.lit(1.0).alias("weight"))
    vectors = spark.createDataFrame(list(VECTORS.items()), "vec_id long, unit array<double>")
    asked = spark.createDataFrame(QUESTIONS, "query_id long, text string, unit array<double>")
    return asked, posting, query_tokens(asked), docs.agg(F.count("*").alias("n")), vectors


def collected(corpus, gates, k=2):
    routes, statuses = hybrid.collect_routes(*corpus, gates, k)
    rows = {}
    for r in routes.orderBy("query_id", "route", "rank").collect():
        rows.setdefault((r.query_id, r.route), []).append(r.doc_id)
    return rows, {(r.query_id, r.route): (r.reason, r.rows) for r in statuses.collect()}


def test_routes_and_reasons(corpus):
    rows, reasons = collected(corpus, hybrid.Gates(coverage=0.5, cosine=0.7))
    assert rows[10, "lexical"] == [1, 2] and rows[10, "vector"] == [1, 2]
    assert rows[11, "lexical"] == [1, 2]  # parents of a topic first, each document once
    assert (12, "vector") not in rows and reasons[12, "vector"] == ("identifier_lexical_miss_skip", 0)
    assert (13, "lexical") not in rows and reasons[13, "lexical"] == ("coverage_below", 0) and rows[13, "vector"] == [3]
    assert reasons[14, "vector"] == ("question_without_vector", 0) and rows[14, "lexical"] == [1, 2]
    assert rows[15, "vector"] == [2, 3] and reasons[15, "vector"] == ("", 2)


def test_without_gates_all_rows_stay(corpus):
    rows, reasons = collected(corpus, hybrid.Gates())
    assert rows[13, "lexical"] == [3] and reasons[13, "lexical"] == ("", 1) and reasons[12, "vector"][0] == "identifier_lexical_miss_skip"


def test_what_is_shown(corpus):
    routes, _ = hybrid.collect_routes(*corpus, hybrid.Gates(), 2)
    shown = lambda *a: {(r.query_id, r["rank"]): (r.display, r.doc_id) for r in hybrid.displayed(routes, corpus[0], *a, 3).collect()}
    assert shown("shadow", "off")[13, 1] == ("lexical", 3) and (13, 2) not in shown("shadow", "off")
    assert shown("on", "off")[13, 1] == ("hybrid", 3) and shown("on", "off")[13, 2][1] == 2
    guarded = shown("shadow", "on")
    assert guarded[11, 1][0] == "guarded_hybrid_fallback" and guarded[13, 1][0] == "lexical"


def test_kinds_of_asking(spark):
    texts = ["BV1xx411c7mD", "ab12", "name 12345678", "abcdefg1", "没有哪些", "哪些文档", "", None]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").select("i", hybrid.opaque_name(F.col("t")).alias("o"), hybrid.asks(F.col("t"), hybrid.TOPIC).alias("a")).orderBy("i").collect()
    assert [r.o for r in rows] == [True, False, False, True, False, False, False, False]
    assert [r.a for r in rows] == [False, False, False, False, False, True, False, False]


def test_questions_are_cut_once_and_not_from_every_document(spark):
    """Tokens of questions were taken from all documents, once a reader, before the filter by id."""
    from corpusmill.operators.lexical import query_tokens
    from corpusmill.plans.hybrid import hybrid_routes

    asked = hybrid_routes(spark, "/root/testdata/sf0.001")[0]
    files = query_tokens(asked.select("query_id", "text")).inputFiles()
    assert asked.count() == 2 and files and not [f for f in files if "documents.parquet" in f]
