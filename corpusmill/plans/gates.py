"""Gates over what the hybrid routes found: documents of another language are out of scope, toxic ones forbidden, poor ones unanswerable."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corpusmill.operators import gates as G
from corpusmill.operators import hybrid
from corpusmill.plans.hybrid import HYBRID, hybrid_routes
from corpusmill.plans.registry import query
from corpusmill.sources.tables import table

REF_SQL = "source || '/' || doc_id || '.md'"
EVIDENCE = f"""{HYBRID}, sh AS (SELECT query_id, doc_id, round(sum(1.0::DOUBLE / (60 + rank)), 6) AS score FROM hr GROUP BY ALL),
top AS (SELECT query_id, doc_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS place FROM sh QUALIFY place <= 8),
ql AS (SELECT q.query_id, d.lang AS scope, {REF_SQL.replace("doc_id", "d.doc_id")} AS own, CASE WHEN l.quality = 0 THEN 'absent' ELSE 'answerable' END AS label FROM qt q JOIN documents d ON d.doc_id = q.query_id LEFT JOIN labels l ON l.doc_id = q.query_id),
ev AS (SELECT t.query_id, place, {REF_SQL.replace("doc_id", "d.doc_id")} AS ref, CASE t.doc_id % 6 WHEN 0 THEN 'archived' WHEN 1 THEN 'candidate' ELSE 'active' END AS status, d.lang AS project, coalesce(l.toxic, 0) = 1 AS bad FROM top t JOIN documents d ON d.doc_id = t.doc_id LEFT JOIN labels l ON l.doc_id = t.doc_id),
rs AS (SELECT ev.query_id, place, ref, CASE WHEN status <> 'active' THEN 'inactive:' || status WHEN project <> scope THEN 'scope_denied' WHEN bad THEN 'forbidden_ref' ELSE '' END AS reason FROM ev JOIN ql USING (query_id)),
gv AS (SELECT query_id, list(ref ORDER BY place) FILTER (reason = '') AS good, list(reason ORDER BY place) FILTER (reason <> '') AS bad FROM rs GROUP BY 1),
gd AS (SELECT query_id, label, own, coalesce(good, []) AS good, list_filter(coalesce(bad, []), lambda x, i: list_position(coalesce(bad, []), x) = i) AS told FROM ql LEFT JOIN gv USING (query_id))"""


@query(f"""WITH {EVIDENCE} SELECT query_id AS task_id, CASE WHEN label = 'absent' OR len(good) = 0 OR NOT list_contains(good, own) THEN 'insufficient' ELSE 'answerable' END AS status,
CASE WHEN label = 'absent' THEN '' ELSE array_to_string(good, '|') END AS allowed,
CASE WHEN label = 'absent' THEN 'answerability_absent' WHEN len(good) = 0 THEN CASE WHEN len(told) > 0 THEN array_to_string(told, '|') ELSE 'no_usable_evidence' END WHEN NOT list_contains(good, own) THEN array_to_string(list_append(told, 'required_ref_missing'), '|') ELSE array_to_string(told, '|') END AS reasons FROM gd""")
def evidence_decisions(spark: SparkSession, d: str) -> DataFrame:
    """Whether what was found for each question may be answered from, and why not. The question's own document is required."""
    tasks, items = evidence(spark, d)
    out = G.evidence_gate(tasks, items)
    return out.select("task_id", "status", F.array_join("allowed", "|").alias("allowed"), F.array_join("reasons", "|").alias("reasons"))


def evidence(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    asked, routes, _ = hybrid_routes(spark, d)
    docs = table(spark, d, "documents").select("doc_id", "lang", F.concat("source", F.lit("/"), F.col("doc_id").cast("string"), F.lit(".md")).alias("ref"))
    labels = table(spark, d, "labels").select("doc_id", "quality", "toxic")
    shown = hybrid.displayed(routes, asked, "on", "off", 8).select("query_id", "doc_id", F.col("rank").alias("place")).join(docs, "doc_id").join(labels.select("doc_id", "toxic"), "doc_id", "left")
    rest = F.col("doc_id") % 6
    status = F.when(rest == 0, "archived").when(rest == 1, "candidate").otherwise("active")
    items = shown.select(F.col("query_id").alias("task_id"), "place", "ref", status.alias("status"), F.col("lang").alias("project_id"))
    bad = shown.where("toxic = 1").groupBy("query_id").agg(F.collect_list("ref").alias("forbidden"))
    own = docs.select(F.col("doc_id").alias("query_id"), "lang", "ref").join(labels.select(F.col("doc_id").alias("query_id"), "quality"), "query_id", "left").join(bad, "query_id", "left")
    tasks = asked.select("query_id").join(own, "query_id").select(
        F.col("query_id").alias("task_id"), F.when(F.col("quality") == 0, "absent").otherwise("answerable").alias("answerability"), F.col("lang").alias("project_id"), F.array("ref").alias("required"), "forbidden"
    )
    return tasks, items


@query(f"""WITH {EVIDENCE}, an AS (SELECT query_id, label, good, CASE query_id // 100 % 5 WHEN 0 THEN 'said in [[' || coalesce(good[1], 'x') || '#a]]' WHEN 1 THEN 'said in [[elsewhere/y.md]]' WHEN 2 THEN 'it is so' WHEN 3 THEN '资料不足' ELSE 'see ' || coalesce(good[1], 'nothing') || ' and [[source]]' END AS answer FROM gd),
s AS (SELECT *, CASE WHEN label = 'absent' THEN 'answerability_absent' WHEN len(good) = 0 THEN 'no_usable_evidence' WHEN query_id // 100 % 5 = 1 THEN 'citation_out_of_scope' WHEN query_id // 100 % 5 = 3 THEN 'explicit_abstention' WHEN query_id // 100 % 5 = 2 THEN 'citation_missing' ELSE '' END AS reason FROM an)
SELECT query_id AS task_id, CASE WHEN reason = '' THEN 'answerable' ELSE 'insufficient' END AS status, CASE WHEN reason = '' THEN good[1] ELSE '' END AS cited, reason, query_id // 100 % 5 = 3 AS abstained FROM s""")
def answer_decisions(spark: SparkSession, d: str) -> DataFrame:
    """Answers of five forms held against the allowed evidence of their questions."""
    tasks, items = evidence(spark, d)
    held = G.evidence_gate(tasks.withColumn("answerability", F.lit("answerable")).withColumn("required", F.array().cast("array<string>")), items).select("task_id", F.col("allowed").alias("refs"))
    form, first = F.floor(F.col("task_id") / 100) % 5, F.get("refs", F.lit(0))
    answer = (
        F.when(form == 0, F.concat(F.lit("said in [["), F.coalesce(first, F.lit("x")), F.lit("#a]]"))).when(form == 1, "said in [[elsewhere/y.md]]")
        .when(form == 2, "it is so").when(form == 3, "资料不足").otherwise(F.concat(F.lit("see "), F.coalesce(first, F.lit("nothing")), F.lit(" and [[source]]")))
    )
    answers = tasks.select("task_id", "answerability").join(held, "task_id").select("task_id", "answerability", "refs", answer.alias("answer"), F.lit("").alias("assessment"))
    return G.answer_gate(answers).select("task_id", "status", F.array_join("cited", "|").alias("cited"), "reason", "abstained")


@query("""WITH u AS (SELECT conv_id, turn, length(text) AS n, row_number() OVER (PARTITION BY conv_id ORDER BY turn, text) AS round FROM conversations WHERE role = 'user')
SELECT conv_id, round::INT AS round, (sum(n) OVER (PARTITION BY conv_id ORDER BY round ROWS 2 PRECEDING))::BIGINT AS chars FROM u QUALIFY round % 3 = 0""")
def sedimentation_rounds(spark: SparkSession, d: str) -> DataFrame:
    """Every third round of a conversation, with the length of what was asked since the last."""
    own = Window.partitionBy("conv_id").orderBy("turn", "text")
    asked = table(spark, d, "conversations").where("role = 'user'").withColumn("round", F.row_number().over(own))
    since = F.sum(F.length("text")).over(Window.partitionBy("conv_id").orderBy("round").rowsBetween(-2, 0))
    return asked.withColumn("chars", since).where("round % 3 = 0").select("conv_id", "round", "chars")
