"""Connected components of a link table by repeated contraction, as DataFrame joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusmill.llm.common import discard, stored


def connected_components(links: DataFrame) -> DataFrame:
    """(id, component) for each id in ``links`` (a, b): the smallest id it reaches.

    In each round every node takes the lowest of itself and its neighbours, by a
    hashed order so that no numbering of the documents makes long chains, jumps
    twice along these choices, and the links are drawn anew between the nodes
    chosen. The number of nodes with links falls by a constant factor a round.
    Rounds end in a table in the shared folder; only a count reaches the driver.
    """
    rank = lambda c: F.struct(F.xxhash64(c).alias("h"), F.col(c).alias("id"))
    edges = stored(links.select("a", "b").where("a <> b").distinct(), "edges")
    steps: list[DataFrame] = []
    while not edges.isEmpty():
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        up = both.groupBy("a").agg(F.least(F.min(rank("b")), F.first(rank("a")))["id"].alias("up"))
        up = stored(up, "parents")
        for _ in range(2):
            above = up.select(F.col("a").alias("up"), F.col("up").alias("top"))
            up = up.join(above, "up").select("a", F.col("top").alias("up"))
        up = stored(up, "parents")
        steps.append(up)
        moved = (
            edges.join(up.withColumnRenamed("up", "ua"), "a")
            .join(up.select(F.col("a").alias("b"), F.col("up").alias("ub")), "b")
            .where("ua <> ub")
            .select(F.least("ua", "ub").alias("a"), F.greatest("ua", "ub").alias("b"))
            .distinct()
        )
        new = stored(moved, "edges")
        discard(edges)
        edges = new
    if not steps:
        return links.select(F.col("a").alias("id"), F.col("b").alias("component")).limit(0)
    roots = steps[0].withColumnRenamed("a", "id")
    for step in steps[1:]:
        roots = (
            roots.join(step.select(F.col("a").alias("up"), F.col("up").alias("top")), "up", "left")
            .select("id", F.coalesce("top", "up").alias("up"))
        )
    roots = stored(roots, "roots")
    least = roots.groupBy("up").agg(F.min("id").alias("component"))
    return roots.join(least, "up").select("id", "component")
