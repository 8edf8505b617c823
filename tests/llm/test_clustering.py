import hashlib

import duckdb
import numpy as np
import pytest

from corpusmill.llm.clustering import Clustering, Moved, cluster_vectors, rounds_sql, squared_distances
from tests.oracle import difference

VECTORS = "vec_id long, embedding array<float>, label int, cluster string, v string"


def plain(rows, plan):
    """Rounds by full scans in Python integers."""
    kept = [(i, [int(np.floor(plan.scale * float(np.float32(x)))) for x in e]) for i, e in rows if e is not None and len(e) == plan.components and all(x is not None and np.isfinite(x) for x in e)]
    first = sorted((hashlib.sha256(f"{plan.seed}:{i}".encode()).hexdigest(), v) for i, v in kept if i is not None)[: plan.clusters]
    centroids = [v for _, v in first]

    def near(v):
        return min((sum((a - b) ** 2 for a, b in zip(v, c, strict=True)), j) for j, c in enumerate(centroids))

    for _ in range(plan.rounds):
        at = [near(v)[1] for _, v in kept]
        for j in range(len(centroids)):
            own = [v for (_, v), a in zip(kept, at, strict=True) if a == j]
            if own:
                centroids[j] = [sum(c) // len(own) for c in zip(*own, strict=True)]
    out = [(i, *near(v)) for i, v in kept]
    inertia = {j: sum(d for _, d, k in out if k == j) for j in range(len(centroids))}
    digest = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]
    return sorted(((i, j, d, inertia[j], sum(inertia.values()), digest[j]) for i, d, j in out), key=str)


def rows_of(df):
    return sorted((tuple(r[c] for c in ("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")) for r in df.collect()), key=str)


def test_equals_plain_rounds_and_sql(spark, sf):
    table = spark.read.parquet(f"{sf}/embeddings.parquet")
    got = cluster_vectors(table)
    assert rows_of(got) == plain([(r.vec_id, r.embedding) for r in table.collect()], Clustering())
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM read_parquet('{sf}/embeddings.parquet')")
    assert difference(got, rounds_sql(), con) == ""


def test_edges(spark):
    plan = Clustering(clusters=3, rounds=4, components=2, scale=4)
    nan, inf = float("nan"), float("inf")
    odd = [(1, None), (2, []), (3, [1.0]), (4, [1.0, None]), (5, [nan, 0.0]), (6, [inf, 1.0]), (None, [0.5, -0.5])]
    good = [(i, [float(i % 3), -float(i % 2)]) for i in range(7, 40)] + [(7, [1.0, 1.0]), (7, [1.0, 1.0]), (50, [-0.1, -0.3])]
    make = lambda rows: spark.createDataFrame([(i, e, 1, "x", "y") for i, e in rows], VECTORS)
    assert rows_of(cluster_vectors(make(odd + good).repartition(5), plan)) == plain(odd + good, plan)
    same = [(i, [2.0, 2.0]) for i in range(10)]
    assert rows_of(cluster_vectors(make(same), plan)) == plain(same, plan)
    assert rows_of(cluster_vectors(make(good[:2]), plan)) == plain(good[:2], plan)
    assert cluster_vectors(make(odd[:6]), plan).count() == 0 and cluster_vectors(make([]), plan).count() == 0
    with pytest.raises(Exception, match="64 bits"):
        cluster_vectors(make([(1, [1e30, 0.0])]), plan).collect()


def test_bounds_hold_and_spare_scans():
    rng = np.random.default_rng(4)
    v = np.concatenate([rng.integers(-9, 9, (300, 6)) + c for c in rng.integers(-300, 300, (5, 6))])
    centroids, old = v[rng.choice(len(v), 5, False)], None
    cluster, upper, lower = np.zeros(len(v), np.int32), np.zeros(len(v)), np.zeros(len(v))
    for _ in range(8):
        moved = Moved(centroids, old)
        moved.assign(v, cluster, upper, lower)
        every = squared_distances(v, centroids)
        assert (cluster == every.argmin(axis=1)).all()
        own = every[np.arange(len(v)), cluster].astype(float)
        every[np.arange(len(v)), cluster] = np.iinfo(np.int64).max
        assert (upper >= np.sqrt(own)).all() and (lower <= np.sqrt(every.min(axis=1))).all()
        old, centroids = centroids, np.array([v[cluster == j].sum(axis=0) // max(1, (cluster == j).sum()) if (cluster == j).any() else centroids[j] for j in range(5)])
