"""Steps that cost once a row or a query: the norm of a vector, the names of documents."""

from corpusmill.operators import vectors
from corpusmill.plans.references import reference_metrics

FOLDER = "/root/testdata/sf0.001"


def test_norm_is_taken_once_a_vector(spark):
    rows = spark.createDataFrame([(1, [3.0, 4.0]), (2, [0.0, 0.0]), (3, None), (4, [None, 1.0]), (5, [])], "vec_id long, embedding array<float>")
    some = vectors.normalised(rows).where("unit IS NOT NULL").select("vec_id", "unit")
    assert [(r.vec_id, r.unit) for r in some.collect()] == [(1, [0.6, 0.8])]
    assert "/ SQRT(" not in some._jdf.queryExecution().optimizedPlan().toString()


def test_documents_are_named_once(spark):
    plan = reference_metrics(spark, FOLDER)._jdf.queryExecution().optimizedPlan().toString()
    assert "sha2(" not in plan
