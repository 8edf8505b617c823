"""Retrieval and answer evaluation over long tables: one row a task, route, rank and reference."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusmill.session import stored


def percentile_at(p: float, column: str, by: list[str], rows: DataFrame, how: str = "floor") -> DataFrame:
    """(by, value): the value at rank floor(p (n - 1)) (or the rounded rank) of each group. The rows are
    dealt out by ranges of group and value; only the range that holds the wanted rank is ranked."""
    rows = stored(rows.select(*by, column).repartitionByRange(*by, column).withColumn("range", F.spark_partition_id()), "ranges")
    own = Window.partitionBy(*by)
    counts = rows.groupBy(*by, "range").agg(F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(own.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    rank = {"floor": F.floor, "round": F.rint}[how](F.lit(p) * (F.sum("n").over(own) - 1))
    wanted = counts.select(*by, "range", "n", before.alias("before"), rank.cast("long").alias("wanted")).where("wanted >= before AND wanted < before + n")
    place = F.row_number().over(Window.partitionBy(*by, "range").orderBy(column)) - 1 + F.col("before")
    return rows.join(wanted, [*by, "range"]).withColumn("place", place).where("place = wanted").select(*by, F.col(column).alias("value"))


def judged(runs: DataFrame, qrels: DataFrame) -> DataFrame:
    """Runs (task_id, route, rank, ref) with ``grade`` and ``is_new``: the first row of each
    relevant reference in its route counts."""
    joined = runs.join(qrels, ["task_id", "ref"], "left").withColumn("grade", F.coalesce("grade", F.lit(0)))
    w = Window.partitionBy("task_id", "route", "ref").orderBy("rank")
    return joined.withColumn("is_new", (F.col("grade") > 0) & (F.row_number().over(w) == 1))


def task_metrics(runs: DataFrame, qrels: DataFrame, routes: list[str], k: int = 10) -> DataFrame:
    """recall@k, MRR, nDCG@k and MAP@k of each task and route. Tasks without relevant
    references count as recall 1 if nothing was returned, else 0, and 0 elsewhere."""
    rows = judged(runs, qrels)
    gain = lambda g, i: (F.pow(F.lit(2.0), g) - 1) / F.log2(i + 1)
    top = F.col("rank") <= k
    hits = F.sum(F.col("is_new").cast("int")).over(Window.partitionBy("task_id", "route").orderBy("rank"))
    rows = rows.withColumn("hits", hits)
    per = rows.groupBy("task_id", "route").agg(
        F.count_if(top).alias("returned"),
        F.count_if(F.col("is_new") & top).alias("found"),
        F.min(F.when(F.col("grade") > 0, F.col("rank"))).alias("first"),
        F.sum(F.when(F.col("is_new") & top, gain(F.col("grade"), F.col("rank"))).otherwise(0.0)).alias("dcg"),
        F.sum(F.when(F.col("is_new") & top, F.col("hits") / F.col("rank")).otherwise(0.0)).alias("ap"),
    )
    ideal = Window.partitionBy("task_id").orderBy(F.desc("grade"), "ref")
    best = (
        qrels.where("grade > 0").withColumn("i", F.row_number().over(ideal)).groupBy("task_id")
        .agg(F.count("*").alias("relevant"), F.sum(F.when(F.col("i") <= k, gain(F.col("grade"), F.col("i"))).otherwise(0.0)).alias("idcg"))
    )
    tasks = runs.select("task_id").unionByName(qrels.select("task_id")).distinct()
    every = tasks.withColumn("route", F.explode(F.array(*map(F.lit, routes))))
    joined = every.join(per, ["task_id", "route"], "left").join(best, "task_id", "left").na.fill(0)
    some = F.col("relevant") > 0
    return joined.select(
        "task_id",
        "route",
        "relevant",
        F.round(F.when(some, F.col("found") / F.col("relevant")).otherwise(F.when(F.col("returned") == 0, 1.0).otherwise(0.0)), 6).alias("recall"),
        F.round(F.when(some & (F.col("first") > 0), 1.0 / F.col("first")).otherwise(0.0), 6).alias("mrr"),
        F.round(F.when(some, F.col("dcg") / F.col("idcg")).otherwise(0.0), 6).alias("ndcg"),
        F.round(F.when(some, F.col("ap") / F.col("relevant")).otherwise(0.0), 6).alias("map"),
    )


def confusion(rows: DataFrame, by: str) -> DataFrame:
    """Overall and by ``by``: precision, recall, false-answer and false-refusal rates of rows
    (answerable, answered)."""
    a, g = F.col("answerable"), F.col("answered")
    tp, fp, fn, tn = F.count_if(a & g), F.count_if(~a & g), F.count_if(a & ~g), F.count_if(~a & ~g)
    rate = lambda x, y: F.round(F.when(y > 0, x / y).otherwise(0.0), 4)
    return rows.rollup(by).agg(
        F.count("*").alias("n"), rate(tp, tp + fp).alias("precision"), rate(tp, tp + fn).alias("recall"),
        rate(fp, fp + tn).alias("false_answer"), rate(fn, tp + fn).alias("false_refusal"),
    )


def answer_figures(rows: DataFrame) -> DataFrame:
    """One row: cases, and the shares of wrong answers and wrong refusals among rows (answerable, answered)."""
    a, g = F.col("answerable"), F.col("answered")
    share = lambda x, y: F.round(F.count_if(x) / F.count_if(y), 6)
    return rows.agg(F.count("*").alias("cases"), share(~a & g, ~a).alias("false_answer"), share(a & ~g, a).alias("false_refusal"))


def gate(figures: DataFrame, checks: dict[str, str]) -> DataFrame:
    """(check_name, passed) for one row of figures; what a figure is missing for has not passed."""
    held = [F.struct(F.lit(n).alias("check_name"), F.coalesce(F.expr(c), F.lit(False)).alias("passed")) for n, c in checks.items()]
    return figures.select(F.inline(F.array(*held)))


def covered_share(tokens: Column, blob: Column, empty: float) -> Column:
    """The share of tokens that a text contains."""
    hit = F.size(F.filter(tokens, lambda t: F.contains(blob, t)))
    return F.when(F.size(tokens) > 0, hit / F.size(tokens)).otherwise(empty)
