"""Vector queries whose ids pass 1,000, against brute force, with blocks of a few queries."""

from corpusmill import catalogue
from tests.test_whole import written


def test_plan_has_no_cross_join(spark, capsys):
    catalogue.queries()["vector_batch"](spark, "/root/testdata/sf0.001").explain()
    plan = capsys.readouterr().out
    assert "MapInArrow" in plan and "Cartesian" not in plan and "NestedLoop" not in plan


def test_every_hundredth_vector_is_asked(spark, tmp_path, monkeypatch):
    import math

    from corpusmill.operators import vectors

    monkeypatch.setattr(vectors, "BLOCK_BYTES", 4 * 3 * 8)
    monkeypatch.setattr(vectors, "PRODUCTS", 40)
    values = {i: [math.sin(i), math.cos(3 * i), math.sin(7 * i + 1)] for i in range(0, 1500, 5)} | {300: [0.0, 0.0, 0.0]}
    written(spark, tmp_path, "embeddings", [(i, v, i % 6) for i, v in values.items()], "vec_id long, embedding array<float>, label int")
    stored = {r.vec_id: list(r.embedding) for r in spark.read.parquet(f"{tmp_path}/embeddings.parquet").collect()}

    def cosine(a, b):
        return round(sum(x * y for x, y in zip(a, b)) / math.sqrt(sum(x * x for x in a) * sum(y * y for y in b)), 6)

    for name, k, floor, fits in (("vector_batch", 20, 0, lambda i: True), ("vector_topk_by_scope", 10, 0.1, lambda i: i % 6 in (1, 3, 5))):
        got = {}
        for r in catalogue.queries()[name](spark, str(tmp_path)).collect():
            got.setdefault(r.query_id, []).append((r["rank"], r.vec_id, round(r.score, 4)))
        want = {}
        for q in set(range(0, 1500, 100)) - {300}:
            scores = sorted((-cosine(stored[q], v), i) for i, v in stored.items() if i != 300 and fits(i))
            want[q] = [(n + 1, i, round(-s, 4)) for n, (s, i) in enumerate(x for x in scores if -x[0] > floor) if n < k]
        assert {q: sorted(v) for q, v in got.items()} == want and 1400 in got
