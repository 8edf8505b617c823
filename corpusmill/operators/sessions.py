"""Folds over one session's rows: ranges of a log, budgets, attempts of stages, ledgers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def folded_ranges(turns: DataFrame, by: str, order: str, tokens: str, every: int) -> DataFrame:
    """``turns`` with ``seq``: the log is cut each ``every`` tokens, so a turn belongs to the range in which it begins."""
    before = F.sum(tokens).over(Window.partitionBy(by).orderBy(order).rowsBetween(Window.unboundedPreceding, -1))
    return turns.withColumn("seq", (F.floor(F.coalesce(before, F.lit(0)) / every) + 1).cast("int"))


def fair_shares(calls: DataFrame, by: str, text: str, total: int, overhead: int) -> DataFrame:
    """``calls`` with ``share``: the characters each may show when ``total`` is split evenly among a session's calls."""
    n = F.count("*").over(Window.partitionBy(by))
    room = F.greatest(F.lit(0), F.lit(total) - overhead * n)
    return calls.withColumn("share", F.least(F.floor(room / n), F.length(F.coalesce(F.col(text), F.lit("")))).cast("int"))


def stage_attempts(log: DataFrame, run: str, stage: str, order: list[str], status: Column) -> DataFrame:
    """(run, stage, place, attempts, status): the stages of a run in the order of their first attempt, and the last status of each."""
    tried = log.groupBy(run, stage).agg(
        F.count("*").alias("attempts"), F.min(F.struct(*order)).alias("began"), F.max_by(status, F.struct(*order)).alias("status")
    )
    place = F.row_number().over(Window.partitionBy(run).orderBy("began", stage))
    return tried.select(run, stage, place.alias("place"), "attempts", "status")


def whole_sample(files: DataFrame, category: str, size: str, key: str, limit: int) -> DataFrame:
    """(key, category, size) of whole files within ``limit``: the smallest of each category, in the order of the
    categories, as far as they fit; then others by size. A file has one category.

    Files of one size are counted, never ranked together: only those of the size at which the limit is met
    are ordered, and of them as many as fit."""
    first = files.groupBy(category).agg(F.min(F.struct(size, key)).alias("f")).select(F.col("f")[key].alias(key), category, F.col("f")[size].alias(size))
    upto = F.sum(size).over(Window.orderBy(category).rowsBetween(Window.unboundedPreceding, 0))
    picks = first.withColumn("used", upto).where(F.col("used") <= limit).drop("used")
    left = F.lit(limit) - F.coalesce(picks.agg(F.sum(size).alias("s")).select("s").scalar(), F.lit(0))
    rest = files.select(key, category, size).join(picks.select(key), key, "left_anti")
    sizes = rest.groupBy(size).agg(F.count("*").alias("n"))
    before = F.coalesce(F.sum(F.col(size) * F.col("n")).over(Window.orderBy(size).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    room = sizes.withColumn("take", F.least(F.col("n"), F.floor((left - before) / F.col(size)))).where("take > 0")
    whole = rest.join(room.where("take = n").select(size), size, "left_semi")
    edge = rest.join(room.where("take < n").select(size, "take"), size)
    some = edge.withColumn("at", F.row_number().over(Window.partitionBy(size).orderBy(key))).where("at <= take")
    return picks.unionByName(whole.select(key, category, size)).unionByName(some.select(key, category, size))
