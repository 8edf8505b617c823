"""Centroid clustering of integer vectors with Hamerly's bounds.

Every vector carries its cluster, one upper bound of the distance to its centroid and one
lower bound of the distance to any other. When centroids move, the bounds are loosened by
their drift. While the upper bound stays below the lower one (or below half the distance
from the centroid to its nearest neighbour) the cluster can't have changed. Otherwise the
upper bound is made exact, and vectors still in doubt get a full scan in 64-bit integers,
ties to the smaller number. So the result is that of plain rounds, tie for tie.

A round is one pass that writes vectors with their bounds to the shared folder, where the
lineage ends, and one over the vectors that moved, which changes sums and counts. Nothing
is shuffled but (clusters x components) partial sums a task; centroids are as many numbers.
Rounds end early only where no centroid moved, for then all later rounds are equal.

Defined cases: a null vector, one of another length or with a null or non-finite component
is left out; a null ``vec_id`` is clustered but no start centroid; repeated rows count each;
equal start hashes are ordered by the vector; fewer vectors than clusters give as many
clusters; other columns are ignored; an empty table gives an empty result. A component so
large that squared distances pass 64 bits raises an error.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusmill.llm.common import discard, small_table, stored

STATE = "vec_id long, v array<int>, cluster int, before int, upper double, lower double"
NAMES = [c.split()[0] for c in STATE.split(", ")]
#: Relative room for the rounding of bounds, which are doubles.
ROOM = 1e-12
#: Rows scanned at once in a task.
ROWS = 4096


@dataclass(frozen=True)
class Clustering:
    clusters: int = 8
    rounds: int = 10
    components: int = 64
    scale: int = 1024
    seed: int = 3


def integer_vectors(vectors: DataFrame, plan: Clustering) -> DataFrame:
    """(vec_id, v) of the usable rows of (vec_id, embedding): floor(scale * x) a component."""
    limit = math.isqrt(2**62 // plan.components) // 2
    x = lambda c: c.cast("double")
    usable = (F.size("embedding") == plan.components) & ~F.exists("embedding", lambda c: c.isNull() | F.isnan(x(c)) | (F.abs(x(c)) == float("inf")))
    too_large = F.exists("embedding", lambda c: F.abs(x(c) * plan.scale) > limit)
    whole = F.transform("embedding", lambda c: F.floor(x(c) * plan.scale).cast("int"))
    error = F.raise_error(F.lit("a component is so large that squared distances pass 64 bits")).cast("array<int>")
    return (
        vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding")
        .where("embedding IS NOT NULL")
        .where(usable)
        .select("vec_id", F.when(too_large, error).otherwise(whole).alias("v"))
    )


def squared_distances(v: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """Exact, as 64-bit integers: one column a centroid."""
    out = np.empty((len(v), len(centroids)), np.int64)
    for j, c in enumerate(centroids):
        apart = v - c
        out[:, j] = np.einsum("ij,ij->i", apart, apart)
    return out


class Moved:
    """Centroids of a round, and how far they moved since the bounds were set."""

    def __init__(self, centroids: np.ndarray, old: np.ndarray | None):
        self.centroids = centroids
        k = len(centroids)
        apart = np.sqrt(np.array([squared_distances(centroids, c[None])[:, 0] for c in centroids], float))
        np.fill_diagonal(apart, np.inf)
        self.half = apart.min(axis=1) / 2 * (1 - ROOM)
        self.drift = None
        if old is not None:
            self.drift = np.sqrt(np.einsum("ij,ij->i", centroids - old, centroids - old).astype(float)) * (1 + ROOM)
            self.others = np.array([np.delete(self.drift, j).max() if k > 1 else 0.0 for j in range(k)])

    def assign(self, v: np.ndarray, cluster: np.ndarray, upper: np.ndarray, lower: np.ndarray) -> None:
        """New cluster and bounds, in place. Without an earlier round all are in doubt."""
        doubt = np.arange(len(v))
        if self.drift is not None:
            upper += self.drift[cluster]
            upper *= 1 + ROOM
            lower -= self.others[cluster]
            lower -= np.abs(lower) * ROOM
            safe = np.maximum(lower, self.half[cluster])
            doubt = np.flatnonzero(~(upper < safe))
            apart = v[doubt] - self.centroids[cluster[doubt]]
            upper[doubt] = np.sqrt(np.einsum("ij,ij->i", apart, apart).astype(float)) * (1 + ROOM)
            doubt = doubt[~(upper[doubt] < safe[doubt])]
        for at in range(0, len(doubt), ROWS):
            rows = doubt[at : at + ROWS]
            found = squared_distances(v[rows], self.centroids)
            best = found.argmin(axis=1)
            cluster[rows] = best
            upper[rows] = np.sqrt(found[np.arange(len(rows)), best].astype(float)) * (1 + ROOM)
            found[np.arange(len(rows)), best] = np.iinfo(np.int64).max
            lower[rows] = np.sqrt(found.min(axis=1).astype(float)) * (1 - ROOM)


def matrix(column: pa.Array, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, width).astype(np.int64)


def assigned(state: DataFrame, moved: Moved, width: int) -> DataFrame:
    """The state after one more assignment; ``before`` is the cluster it had."""
    first = moved.drift is None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.num_rows
            if first:
                before, upper, lower = np.full(n, -1, np.int32), np.zeros(n), np.zeros(n)
            else:
                before, upper, lower = (batch.column(i).to_numpy(zero_copy_only=False) for i in (2, 4, 5))
            cluster, upper, lower = (np.array(x) for x in (before, upper, lower))
            moved.assign(matrix(batch.column(1), width), cluster, upper, lower)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *map(pa.array, (cluster, before, upper, lower))], names=NAMES)

    return state.mapInArrow(run, STATE)


def changes(state: DataFrame, clusters: int, width: int) -> list[tuple[int, int, int]]:
    """(cluster, component, sum) by which the moved vectors change the sums; component
    ``width`` holds counts. One row a cluster and component reaches the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((clusters, width + 1), np.int64)
        for batch in batches:
            ones = np.ones((batch.num_rows, 1), np.int64)
            v = np.hstack([matrix(batch.column(0), width), ones])
            now, before = (batch.column(i).to_numpy() for i in (1, 2))
            np.add.at(total, now, v)
            np.subtract.at(total, before[before >= 0], v[before >= 0])
        j, i = (x.ravel() for x in np.indices(total.shape))
        yield pa.RecordBatch.from_arrays([pa.array(j, pa.int32()), pa.array(i, pa.int32()), pa.array(total.ravel())], names=["cluster", "i", "part"])

    parts = state.where("cluster <> before").select("v", "cluster", "before").mapInArrow(run, "cluster int, i int, part long")
    return [(r.cluster, r.i, int(r.part)) for r in parts.groupBy("cluster", "i").agg(F.sum(F.col("part").cast("decimal(20,0)")).alias("part")).collect()]


def start_centroids(vectors: DataFrame, plan: Clustering) -> np.ndarray:
    """The vectors with the smallest hashes of their ids."""
    place = F.sha2(F.concat(F.lit(f"{plan.seed}:"), F.col("vec_id").cast("string")), 256)
    rows = vectors.where("vec_id IS NOT NULL").select(place.alias("place"), "v").orderBy("place", "v").limit(plan.clusters).collect()
    return np.array([r.v for r in rows], np.int64).reshape(-1, plan.components)


def cluster_vectors(vectors: DataFrame, plan: Clustering = Clustering()) -> DataFrame:
    """(vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256) for each usable row
    of (vec_id, embedding); ``distance`` is squared, in units of 1 / scale."""
    spark, width = vectors.sparkSession, plan.components
    state = stored(integer_vectors(vectors, plan), "vectors")
    centroids, old = start_centroids(state, plan), None
    k = len(centroids)
    if not k:
        return state.limit(0).selectExpr("vec_id", "0 cluster", "0L distance", "0L cluster_inertia", "0L inertia", "'' centroid_sha256")
    sums = [[0] * (width + 1) for _ in range(k)]
    for step in range(plan.rounds + 1):
        new = stored(assigned(state, Moved(centroids, old), width), "bounds")
        discard(state)
        state = new
        if step == plan.rounds:
            break
        for j, i, part in changes(state, k, width):
            sums[j][i] += part
        means = [[s // row[-1] for s in row[:-1]] if row[-1] else c.tolist() for row, c in zip(sums, centroids, strict=True)]
        old, centroids = centroids, np.array(means, np.int64)
        if (old == centroids).all():
            break
    rows = [(j, [int(x) for x in c]) for j, c in enumerate(centroids)]
    centres = small_table(spark, rows, "cluster int, c array<long>").withColumn("centroid_sha256", F.sha2(F.array_join(F.col("c").cast("array<string>"), ","), 256))
    apart = F.zip_with("v", "c", lambda a, b: (a - b) * (a - b))
    placed = state.join(F.broadcast(centres), "cluster").select("vec_id", "cluster", F.aggregate(apart, F.lit(0).cast("long"), lambda s, x: s + x).alias("distance"), "centroid_sha256")
    total = F.sum(F.col("distance").cast("decimal(20,0)"))
    inertias = [(r.cluster, int(r.total)) for r in placed.groupBy("cluster").agg(total.alias("total")).collect()]
    whole = sum(t for _, t in inertias)
    by_cluster = small_table(spark, [(j, t, whole) for j, t in inertias], "cluster int, cluster_inertia long, inertia long")
    return placed.join(F.broadcast(by_cluster), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def rounds_sql(plan: Clustering = Clustering()) -> str:
    """The same rounds in DuckDB's SQL, one pair of tables a round."""
    nearest = "(SELECT vec_id, v, cluster, distance FROM (SELECT vec_id, v, cluster, distance, row_number() OVER (PARTITION BY row ORDER BY distance, cluster) AS rn FROM (SELECT row, vec_id, v, cluster, list_sum(list_transform(list_zip(v, c), lambda p: (p[1] - p[2]) * (p[1] - p[2])))::BIGINT AS distance FROM vectors CROSS JOIN {c})) WHERE rn = 1)"
    parts = [
        f"kept AS (SELECT vec_id, embedding FROM embeddings WHERE len(embedding) = {plan.components} AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)",
        f"vectors AS MATERIALIZED (SELECT row_number() OVER () AS row, vec_id, list_transform(embedding, lambda x: floor({plan.scale} * x::DOUBLE)::BIGINT) AS v FROM kept)",
        f"c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY place, v) - 1 AS cluster, v AS c FROM (SELECT sha256('{plan.seed}:' || vec_id) AS place, v FROM vectors WHERE vec_id IS NOT NULL ORDER BY place, v LIMIT {plan.clusters}))",
    ]
    for r in range(plan.rounds):
        parts.append(f"a{r} AS MATERIALIZED {nearest.format(c=f'c{r}')}")
        means = f"SELECT cluster, list(m ORDER BY i) AS c FROM (SELECT cluster, i, ((s - ((s % n) + n) % n) // n)::BIGINT AS m FROM (SELECT cluster, i, sum(x)::HUGEINT AS s, count(*) AS n FROM (SELECT cluster, unnest(v) AS x, generate_subscripts(v, 1) AS i FROM a{r}) GROUP BY cluster, i)) GROUP BY cluster"
        parts.append(f"c{r + 1} AS MATERIALIZED (SELECT o.cluster, coalesce(m.c, o.c) AS c FROM c{r} o LEFT JOIN ({means}) m ON o.cluster = m.cluster)")
    last = f"c{plan.rounds}"
    parts.append(f"placed AS MATERIALIZED {nearest.format(c=last)}")
    return (
        "WITH " + ",\n".join(parts) + "\nSELECT p.vec_id, p.cluster::INTEGER AS cluster, p.distance, (sum(p.distance) OVER (PARTITION BY p.cluster))::BIGINT AS cluster_inertia, "
        f"(sum(p.distance) OVER ())::BIGINT AS inertia, sha256(array_to_string(l.c, ',')) AS centroid_sha256 FROM placed p JOIN {last} l ON p.cluster = l.cluster"
    )


