"""Judging retrieved references against expected ones that name a file, an entry or a chunk.

An expected reference with an anchor stands for an entry: it is met by itself and by the entry's chunks. One
without stands for a file: it is met by anything of that file. References are exploded to keys of these kinds,
so that meeting is an equi-join, never a comparison of all with all.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def clean_reference(ref: Column) -> Column:
    """With forward slashes, without white space at the ends."""
    return F.trim(F.replace(F.coalesce(ref, F.lit("")), F.lit("\\"), F.lit("/")))


def own_key(ref: Column) -> Column:
    """The one key that an expected reference asks for."""
    return F.when(F.contains(ref, F.lit("#")), F.struct(F.lit("entry").alias("kind"), ref.alias("name"))).otherwise(F.struct(F.lit("file").alias("kind"), ref.alias("name")))


def keys_met(ref: Column) -> Column:
    """The keys that a retrieved reference meets: its file, itself, and what stands before each chunk suffix."""
    parts = F.split(ref, ":ch")
    heads = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, F.lit(1), n), ":ch"))
    entries = F.filter(F.array_distinct(heads), lambda h: F.contains(h, F.lit("#")))
    file = F.struct(F.lit("file").alias("kind"), F.substring_index(ref, "#", 1).alias("name"))
    return F.concat(F.array(file), F.transform(entries, lambda e: F.struct(F.lit("entry").alias("kind"), e.alias("name"))))


def met(runs: DataFrame, expected: DataFrame, k: int) -> DataFrame:
    """(task_id, route, rank, ref, grade, place): which expected references each of the first ``k`` rows meets. ``runs``:
    task_id, route, rank, ref; ``expected``: task_id, ref, grade, place."""
    got = runs.where(F.col("rank") <= k).select("task_id", "route", "rank", F.explode(keys_met(clean_reference(F.col("ref")))).alias("key"))
    return got.join(expected.withColumn("key", own_key(F.col("ref"))), ["task_id", "key"]).select("task_id", "route", "rank", "ref", "grade", "place").distinct()


def labels(qrels: DataFrame) -> DataFrame:
    """(task_id, ref, grade, place): each expected reference once, with its highest grade, in the order of ``place``."""
    clean = qrels.select("task_id", clean_reference(F.col("ref")).alias("ref"), F.greatest(F.lit(0), F.col("grade")).alias("grade"), "place").where("ref <> ''")
    return clean.groupBy("task_id", "ref").agg(F.max("grade").alias("grade"), F.min("place").alias("place"))


def gain(grade: Column, place: Column) -> Column:
    return (F.pow(F.lit(2.0), grade) - 1) / F.log2(place + 1)


def greedy_gains(meets: DataFrame) -> DataFrame:
    """(task_id, route, dcg, taken): down the ranks, each row takes the highest grade among the references it meets that no
    row before it took, the first in order among equals. A fold over at most ``k`` ranks of a task and route."""
    order = lambda m: F.array_sort(m, lambda x, y: F.when(x["grade"] != y["grade"], F.sign(y["grade"] - x["grade"]).cast("int")).otherwise(F.sign(x["place"] - y["place"]).cast("int")))
    ranks = meets.where("grade > 0").groupBy("task_id", "route", "rank").agg(order(F.collect_list(F.struct("ref", "grade", "place"))).alias("m"))
    lists = ranks.groupBy("task_id", "route").agg(F.array_sort(F.collect_list(F.struct("rank", "m"))).alias("rows"))
    start = F.struct(F.array().cast("array<string>").alias("used"), F.lit(0.0).alias("dcg"))

    def step(s: Column, row: Column) -> Column:
        pick = F.get(F.filter(row["m"], lambda m: ~F.array_contains(s["used"], m["ref"])), F.lit(0))
        some = pick.isNotNull()
        return F.struct(F.when(some, F.concat(s["used"], F.array(pick["ref"]))).otherwise(s["used"]).alias("used"), F.when(some, s["dcg"] + gain(pick["grade"], row["rank"])).otherwise(s["dcg"]).alias("dcg"))

    done = F.aggregate("rows", start, step)
    return lists.select("task_id", "route", done["dcg"].alias("dcg"), done["used"].alias("taken"))


def reference_metrics(runs: DataFrame, qrels: DataFrame, groups: DataFrame, routes: list[str], k: int) -> DataFrame:
    """(task_id, route, recall, mrr, ndcg, map) of every task of ``groups`` or ``runs`` for every one of ``routes``.

    ``qrels``: task_id, ref, grade, place. ``groups``: task_id, group_no, ref: what has to be found; a group is met by one
    of its references. Without groups recall is 1 if nothing was returned, else 0."""
    known = labels(qrels)
    meets = met(runs, known, k)
    wanted = groups.select("task_id", "group_no", clean_reference(F.col("ref")).alias("ref")).where("ref <> ''").distinct()
    asked = met(runs, wanted.select("task_id", "ref").distinct().withColumns({"grade": F.lit(1), "place": F.lit(0)}), 2**31 - 1)
    first = asked.groupBy("task_id", "route").agg(F.min("rank").alias("first"))
    reached = asked.where(F.col("rank") <= k).select("task_id", "route", "ref").distinct().join(wanted, ["task_id", "ref"]).groupBy("task_id", "route").agg(F.countDistinct("group_no").alias("reached"))
    need = wanted.groupBy("task_id").agg(F.countDistinct("group_no").alias("groups"))
    ideal = F.row_number().over(Window.partitionBy("task_id").orderBy(F.desc("grade"), "place"))
    best = known.where("grade > 0").withColumn("i", ideal).groupBy("task_id").agg(F.count("*").alias("relevant"), F.sum(F.when(F.col("i") <= k, gain(F.col("grade"), F.col("i"))).otherwise(0.0)).alias("idcg"))
    matched = meets.where("grade > 0").groupBy("task_id", "route", "rank").agg(F.min_by("ref", F.struct("place", "ref")).alias("ref"))
    fresh = matched.withColumn("new", F.row_number().over(Window.partitionBy("task_id", "route", "ref").orderBy("rank")) == 1).where("new")
    hits = fresh.withColumn("hits", F.row_number().over(Window.partitionBy("task_id", "route").orderBy("rank")))
    precision = hits.groupBy("task_id", "route").agg(F.sum(F.col("hits") / F.col("rank")).alias("ap"))
    returned = runs.where(F.col("rank") <= k).groupBy("task_id", "route").agg(F.count("*").alias("returned"))
    every = runs.select("task_id").union(groups.select("task_id")).distinct().withColumn("route", F.explode(F.array(*map(F.lit, routes))))
    for part in (first, reached, precision, returned, greedy_gains(meets)):
        every = every.join(part, ["task_id", "route"], "left")
    every = every.join(need, "task_id", "left").join(best, "task_id", "left").na.fill(0)
    none = F.col("groups") == 0
    return every.select(
        "task_id", "route",
        F.round(F.when(none, F.when(F.col("returned") == 0, 1.0).otherwise(0.0)).otherwise(F.col("reached") / F.col("groups")), 6).alias("recall"),
        F.round(F.when(~none & (F.col("first") > 0), 1.0 / F.col("first")).otherwise(0.0), 6).alias("mrr"),
        F.round(F.when(F.col("idcg") > 0, F.col("dcg") / F.col("idcg")).otherwise(0.0), 6).alias("ndcg"),
        F.round(F.when(F.col("relevant") > 0, F.coalesce("ap", F.lit(0.0)) / F.col("relevant")).otherwise(0.0), 6).alias("map"),
    )
