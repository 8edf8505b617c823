"""Evaluation queries. A document is relevant to a benchmark item if it holds one of its lines."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusmill.functions import text as T
from corpusmill.operators import evaluation as E
from corpusmill.operators.lexical import top_k
from corpusmill.plans.registry import query
from corpusmill.plans.retrieval import ROUTES, routes
from corpusmill.session import stored
from corpusmill.sources.tables import table

LINES = "unnest(string_split(text, chr(10)))"
QRELS = f"""il AS (SELECT item_id AS task_id, {LINES} AS line FROM benchmark), dl AS (SELECT doc_id AS ref, {LINES} AS line FROM documents),
qrels AS (SELECT task_id, ref, least(2, count(DISTINCT line))::INT AS grade FROM il JOIN dl USING (line) WHERE length(line) >= 30 GROUP BY ALL)"""
JUDGED = f"""{ROUTES}, {QRELS}, runs AS (SELECT query_id AS task_id, route, doc_id AS ref, rank FROM routes),
j AS (SELECT task_id, route, ref, rank, coalesce(grade, 0) AS grade FROM runs LEFT JOIN qrels USING (task_id, ref)),
h AS (SELECT *, sum((grade > 0)::INT) OVER (PARTITION BY task_id, route ORDER BY rank) AS hits FROM j),
per AS (SELECT task_id, route, count(*) FILTER (rank <= 10) AS returned, count(*) FILTER (grade > 0 AND rank <= 10) AS found, min(rank) FILTER (grade > 0) AS first,
 coalesce(sum((pow(2.0, grade) - 1) / log2(rank + 1)) FILTER (grade > 0 AND rank <= 10), 0) AS dcg, coalesce(sum(hits / rank) FILTER (grade > 0 AND rank <= 10), 0) AS ap FROM h GROUP BY ALL),
o AS (SELECT task_id, grade, row_number() OVER (PARTITION BY task_id ORDER BY grade DESC, ref) AS i FROM qrels),
best AS (SELECT task_id, count(*) AS relevant, sum((pow(2.0, grade) - 1) / log2(i + 1)) FILTER (i <= 10) AS idcg FROM o GROUP BY 1),
m AS (SELECT t.task_id, r.route, coalesce(relevant, 0) AS relevant,
 round(CASE WHEN relevant > 0 THEN coalesce(found, 0) / relevant WHEN coalesce(returned, 0) = 0 THEN 1.0 ELSE 0.0 END, 6) AS recall,
 round(CASE WHEN relevant > 0 AND first > 0 THEN 1.0 / first ELSE 0.0 END, 6) AS mrr, round(CASE WHEN relevant > 0 THEN coalesce(dcg, 0) / idcg ELSE 0.0 END, 6) AS ndcg,
 round(CASE WHEN relevant > 0 THEN coalesce(ap, 0) / relevant ELSE 0.0 END, 6) AS map
 FROM (SELECT DISTINCT task_id FROM runs UNION SELECT DISTINCT task_id FROM qrels) t CROSS JOIN (VALUES ('content'), ('fields')) r(route) LEFT JOIN per USING (task_id, route) LEFT JOIN best ON best.task_id = t.task_id)"""


def qrels(spark: SparkSession, d: str) -> DataFrame:
    """(task_id, ref, grade), stored: documents that share one (1) or more (2) lines with an item. A document's lines are told apart
    in its row; only those that an item has are brought together."""
    line = F.explode(F.array_distinct(F.filter(F.split("text", "\n", -1), lambda x: F.length(x) >= 30))).alias("line")
    item = table(spark, d, "benchmark").select(F.col("item_id").alias("task_id"), line).distinct()
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("ref"), line)
    shared = docs.join(item, "line").groupBy("task_id", "ref").agg(F.least(F.lit(2), F.countDistinct("line")).cast("int").alias("grade"))
    return stored(shared, "qrels")


def runs(spark: SparkSession, d: str) -> DataFrame:
    return routes(spark, d).select(F.col("query_id").alias("task_id"), "route", F.col("doc_id").alias("ref"), "rank")


def metrics(spark: SparkSession, d: str) -> DataFrame:
    return E.task_metrics(runs(spark, d), qrels(spark, d), ["content", "fields"])


@query(f"WITH {JUDGED} SELECT * FROM m")
def retrieval_metrics(spark: SparkSession, d: str) -> DataFrame:
    return metrics(spark, d)


@query(f"WITH {JUDGED} SELECT route, count(*) AS tasks, round(avg(recall), 4) AS recall, round(avg(mrr), 4) AS mrr, round(avg(ndcg), 4) AS ndcg, round(avg(map), 4) AS map FROM m WHERE relevant > 0 GROUP BY 1")
def metric_summary(spark: SparkSession, d: str) -> DataFrame:
    """Means over tasks with relevant references."""
    some = metrics(spark, d).where("relevant > 0")
    return some.groupBy("route").agg(F.count("*").alias("tasks"), *[F.round(F.avg(c), 4).alias(c) for c in ("recall", "mrr", "ndcg", "map")])


@query(f"""WITH {JUDGED}, p AS (SELECT task_id, max(ndcg) FILTER (route = 'fields') - max(ndcg) FILTER (route = 'content') AS delta FROM m WHERE relevant > 0 GROUP BY 1)
SELECT count(*) AS tasks, round(avg(delta), 6) AS mean_delta, count(*) FILTER (delta < 0) AS regressions, count(*) FILTER (delta > 0) AS gains FROM p""")
def route_deltas(spark: SparkSession, d: str) -> DataFrame:
    by = metrics(spark, d).where("relevant > 0").groupBy("task_id").pivot("route", ["content", "fields"]).agg(F.first("ndcg"))
    delta = F.col("fields") - F.col("content")
    return by.agg(F.count("*").alias("tasks"), F.round(F.avg(delta), 6).alias("mean_delta"), F.count_if(delta < 0).alias("regressions"), F.count_if(delta > 0).alias("gains"))


@query(f"""WITH {JUDGED}, q AS (SELECT task_id, bool_or(grade > 0 AND rank <= 10) AS any_hit, bool_and(hit) AS all_hit FROM (SELECT task_id, ref, max(grade) AS grade, min(rank) AS rank, bool_or(rank <= 10) AS hit FROM j WHERE grade > 0 GROUP BY ALL) GROUP BY 1)
SELECT count(*) FILTER (any_hit) AS any_hit, count(*) FILTER (all_hit) AS all_hit, count(*) AS tasks FROM q""")
def route_coverage(spark: SparkSession, d: str) -> DataFrame:
    hits = E.judged(runs(spark, d), qrels(spark, d)).where("grade > 0").groupBy("task_id", "ref").agg(F.bool_or(F.col("rank") <= 10).alias("hit"))
    q = hits.groupBy("task_id").agg(F.bool_or("hit").alias("any_hit"), F.bool_and("hit").alias("all_hit"))
    return q.agg(F.count_if("any_hit").alias("any_hit"), F.count_if("all_hit").alias("all_hit"), F.count("*").alias("tasks"))


@query(f"""WITH {ROUTES} SELECT route, count(*) AS n, count(*) FILTER (toxic = 1) AS forbidden, round(1 - count(DISTINCT query_id) FILTER (toxic = 1) / count(DISTINCT query_id), 4) AS clean_rate
FROM routes LEFT JOIN labels USING (doc_id) WHERE rank <= 10 GROUP BY route""")
def forbidden_hits(spark: SparkSession, d: str) -> DataFrame:
    """Toxic documents among the best ten, and the share of queries without any."""
    bad = F.col("toxic") == 1
    rows = routes(spark, d).where("rank <= 10").join(table(spark, d, "labels"), "doc_id", "left")
    return rows.groupBy("route").agg(
        F.count("*").alias("n"), F.count_if(bad).alias("forbidden"),
        F.round(1 - F.countDistinct(F.when(bad, F.col("query_id"))) / F.countDistinct("query_id"), 4).alias("clean_rate"),
    )


@query(f"""WITH {ROUTES}, buckets AS (SELECT query_id, source, count(*) AS c FROM routes JOIN documents USING (doc_id) WHERE route = 'content' GROUP BY ALL)
SELECT query_id, round(sum(c - 1) / sum(c), 3) AS dup_ratio FROM buckets GROUP BY 1""")
def bucket_duplicate_ratio(spark: SparkSession, d: str) -> DataFrame:
    rows = routes(spark, d).where("route = 'content'").join(table(spark, d, "documents").select("doc_id", "source"), "doc_id")
    b = rows.groupBy("query_id", "source").agg(F.count("*").alias("c"))
    return b.groupBy("query_id").agg(F.round(F.sum(F.col("c") - 1) / F.sum("c"), 3).alias("dup_ratio"))


@query("""WITH v AS (SELECT event_type, list_sort(list(value)) AS v FROM events GROUP BY 1)
SELECT event_type, v[floor(0.5 * (len(v) - 1))::INT + 1] AS p50, v[floor(0.95 * (len(v) - 1))::INT + 1] AS p95 FROM v""")
def latency_percentiles(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "events").select("event_type", "value")
    p50 = E.percentile_at(0.5, "value", ["event_type"], rows).withColumnRenamed("value", "p50")
    return p50.join(E.percentile_at(0.95, "value", ["event_type"], rows).withColumnRenamed("value", "p95"), "event_type")


@query("""WITH r AS (SELECT o_orderpriority AS kind, o_totalprice > 150000 AS answerable, o_orderkey % 3 <> 0 AS answered FROM orders)
SELECT kind, count(*) AS n, round(CASE WHEN count(*) FILTER (answered) > 0 THEN count(*) FILTER (answerable AND answered) / count(*) FILTER (answered) ELSE 0 END, 4) AS precision,
round(count(*) FILTER (answerable AND answered) / count(*) FILTER (answerable), 4) AS recall, round(count(*) FILTER (NOT answerable AND answered) / count(*) FILTER (NOT answerable), 4) AS false_answer,
round(count(*) FILTER (answerable AND NOT answered) / count(*) FILTER (answerable), 4) AS false_refusal FROM r GROUP BY ROLLUP (kind)""")
def answer_gate_confusion(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "orders").select(F.col("o_orderpriority").alias("kind"), (F.col("o_totalprice") > 150000).alias("answerable"), (F.col("o_orderkey") % 3 != 0).alias("answered"))
    return E.confusion(rows, "kind")


@query(f"""WITH {JUDGED}, s AS (SELECT route, CASE WHEN task_id % 2 = 0 THEN 'even' ELSE 'odd' END AS kind, recall, mrr FROM m)
SELECT route, kind, count(*) AS n, round(avg(recall), 4) AS recall, round(avg(mrr), 4) AS mrr, grouping_id(route, kind)::BIGINT AS level FROM s GROUP BY CUBE (route, kind)""")
def policy_sweep_cube(spark: SparkSession, d: str) -> DataFrame:
    s = metrics(spark, d).withColumn("kind", F.when(F.col("task_id") % 2 == 0, "even").otherwise("odd"))
    return s.cube("route", "kind").agg(F.count("*").alias("n"), F.round(F.avg("recall"), 4).alias("recall"), F.round(F.avg("mrr"), 4).alias("mrr"), F.grouping_id().alias("level"))


@query("""WITH c AS (SELECT user_id, event_type, count(*) AS n, min(event_id) AS first_at FROM events GROUP BY ALL)
SELECT user_id, count(*) AS distinct_values, arg_max(event_type, (n, -first_at)) AS majority, round(max(n) / sum(n), 4) AS rate FROM c GROUP BY 1""")
def repeat_stability(spark: SparkSession, d: str) -> DataFrame:
    """Distinct answers, the majority (the first seen of equals) and its share."""
    c = table(spark, d, "events").groupBy("user_id", "event_type").agg(F.count("*").alias("n"), F.min("event_id").alias("f"))
    return c.groupBy("user_id").agg(
        F.count("*").alias("distinct_values"), F.max(F.struct("n", (-F.col("f")).alias("f"), "event_type"))["event_type"].alias("majority"),
        F.round(F.max("n") / F.sum("n"), 4).alias("rate"),
    )


@query(f"""WITH {JUDGED}, s AS (SELECT avg(recall) FILTER (route = 'fields') AS candidate, avg(recall) FILTER (route = 'content') AS frozen, count(*) FILTER (route = 'fields') AS cases FROM m WHERE relevant > 0),
c AS (SELECT 'recall_regression' AS check_name, candidate >= frozen AS passed FROM s UNION ALL SELECT 'enough_cases', cases >= 20 FROM s UNION ALL SELECT 'recall_floor', candidate >= 0.5 FROM s)
SELECT check_name, passed FROM c""")
def promotion_gate(spark: SparkSession, d: str) -> DataFrame:
    """Threshold checks on one row of figures, as rows."""
    of = lambda route: F.col("route") == route
    some = metrics(spark, d).where("relevant > 0").agg(
        F.avg(F.when(of("fields"), F.col("recall"))).alias("fields_r"), F.avg(F.when(of("content"), F.col("recall"))).alias("content_r"), F.count_if(of("fields")).alias("fields_n")
    )
    checks = F.array(
        F.struct(F.lit("recall_regression").alias("check_name"), (F.col("fields_r") >= F.col("content_r")).alias("passed")),
        F.struct(F.lit("enough_cases").alias("check_name"), (F.col("fields_n") >= 20).alias("passed")),
        F.struct(F.lit("recall_floor").alias("check_name"), (F.col("fields_r") >= 0.5).alias("passed")),
    )
    return some.select(F.inline(checks))


MTOK = r"list_distinct(list_transform(regexp_extract_all({c}, '[a-zA-Z][a-zA-Z0-9_]{{1,}}|\d+(?:\.\d+)?'), lambda t: lower(t)))"


@query(f"""WITH p AS (SELECT u.conv_id, u.turn, u.text AS question, a.text AS answer FROM conversations u JOIN conversations a ON a.conv_id = u.conv_id AND a.turn = u.turn + 1 WHERE u.role = 'user' AND a.role = 'assistant'),
t AS (SELECT *, {MTOK.format(c="question")} AS q, {MTOK.format(c="answer")} AS t FROM p)
SELECT conv_id, turn, round(CASE WHEN len(q) > 0 THEN len(list_filter(q, lambda x: contains(lower(answer), x))) / len(q) ELSE 0 END, 6) AS relevancy,
round(CASE WHEN len(t) > 0 THEN len(list_filter(t, lambda x: contains(lower(question), x))) / len(t) ELSE 1 END, 6) AS faithfulness FROM t""")
def rag_token_metrics(spark: SparkSession, d: str) -> DataFrame:
    """Question tokens found in the answer, and answer tokens found in the question as context."""
    c = table(spark, d, "conversations")
    u = c.where("role = 'user'").select("conv_id", "turn", F.col("text").alias("question"))
    a = c.where("role = 'assistant'").select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("answer"))
    relevancy = E.covered_share(T.metric_tokens(F.col("question")), F.lower("answer"), 0.0)
    faithful = E.covered_share(T.metric_tokens(F.col("answer")), F.lower("question"), 1.0)
    return u.join(a, ["conv_id", "turn"]).select("conv_id", "turn", F.round(relevancy, 6).alias("relevancy"), F.round(faithful, 6).alias("faithfulness"))


@query("""WITH e AS (SELECT item_id, CASE WHEN length(text) < 100 THEN 'short' END AS a, CASE WHEN NOT regexp_matches(text, '\\.$') THEN 'no_stop' END AS b, CASE WHEN contains(text, chr(10)) THEN 'many_lines' END AS c FROM benchmark)
SELECT item_id, concat_ws('|', a, b, c) AS problems FROM e""".replace("\\\\", "\\"))
def task_validation(spark: SparkSession, d: str) -> DataFrame:
    """Rule checks of evaluation tasks as one list of problems."""
    t = F.col("text")
    rules = F.array_compact(F.array(F.when(F.length(t) < 100, "short"), F.when(~t.rlike(r"\.$"), "no_stop"), F.when(F.contains(t, F.lit("\n")), "many_lines")))
    return table(spark, d, "benchmark").select("item_id", F.array_join(rules, "|").alias("problems"))


@query("""WITH s AS (SELECT item_id, CASE WHEN item_id % 2 = 0 THEN 'negative' ELSE 'type' || (item_id % 5) END AS kind FROM benchmark)
SELECT kind, item_id FROM s QUALIFY row_number() OVER (PARTITION BY kind ORDER BY item_id) <= CASE WHEN kind = 'negative' THEN 5 ELSE 1 END""")
def select_tasks(spark: SparkSession, d: str) -> DataFrame:
    """Some negative tasks and one of each other type."""
    kind = F.when(F.col("item_id") % 2 == 0, "negative").otherwise(F.concat(F.lit("type"), (F.col("item_id") % 5).cast("string")))
    first = top_k(table(spark, d, "benchmark").select("item_id", kind.alias("kind")), 5, ["kind"], "item_id")
    return first.where("kind = 'negative' OR rank = 1").select("kind", "item_id")


@query("""SELECT event_type, round(min(value), 4) AS low, round(max(value), 4) AS high, round(avg(value), 4) AS mean, count(DISTINCT date_trunc('day', ts)) AS days FROM events GROUP BY 1""")
def timing_distribution(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").groupBy("event_type").agg(
        F.round(F.min("value"), 4).alias("low"), F.round(F.max("value"), 4).alias("high"), F.round(F.avg("value"), 4).alias("mean"),
        F.countDistinct(F.date_trunc("day", "ts")).alias("days"),
    )
