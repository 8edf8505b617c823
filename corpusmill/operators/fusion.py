"""Rank fusion of retrieval routes."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpusmill.operators.lexical import top_k

RRF_K = 60


def route_ranks(rows: DataFrame) -> DataFrame:
    """Rows (query_id, route, rank, key, ...) with ranks among the first of each key in its
    route. The row kept is the first with body text (``heading_only`` false), if any."""
    own = Window.partitionBy("query_id", "route", "key")
    first = F.min("rank").over(own)
    kept = rows.withColumn("place", first).withColumn("pick", F.row_number().over(own.orderBy("heading_only", "rank"))).where("pick = 1")
    again = Window.partitionBy("query_id", "route").orderBy("place", "key")
    return kept.withColumn("rank", F.row_number().over(again)).drop("place", "pick")


def reciprocal_rank_fusion(ranked: DataFrame, k: int, weights: DataFrame | None = None, rrf_k: int = RRF_K) -> DataFrame:
    """(query_id, key, score, rank) by the summed (weighted) reciprocal ranks; ties by key.

    ``weights``: variant, route, weight; its variants are fused side by side."""
    by = ["query_id"]
    if weights is not None:
        ranked = ranked.join(F.broadcast(weights.where("weight > 0")), "route")
        by = ["variant", "query_id"]
    weight = F.col("weight") if weights is not None else F.lit(1.0)
    fused = ranked.groupBy(*by, "key").agg(F.round(F.sum(weight / (rrf_k + F.col("rank"))), 6).alias("score"))
    return top_k(fused, k, by, F.desc("score"), "key")


def diversified(rows: DataFrame, document: str, limit: int) -> DataFrame:
    """The best row of each document first, then the others, in rank order."""
    own = Window.partitionBy("query_id", document).orderBy("rank")
    repeat = F.row_number().over(own) > 1
    picked = rows.withColumn("repeat", repeat)
    return top_k(picked.withColumnRenamed("rank", "old_rank"), limit, ["query_id"], "repeat", "old_rank").drop("repeat")
