"""Retrieved chunks judged against references that name files, entries and chunks, which overlap."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusmill.operators import references as R
from corpusmill.plans.evaluations import QRELS, qrels
from corpusmill.plans.registry import query
from corpusmill.plans.retrieval import ROUTES, routes
from corpusmill.session import stored
from corpusmill.sources.tables import table

#: A document's chunk: its file, one of three entries, and a content hash.
CHUNK_SQL = "source || '/' || doc_id || '.md#e' || (doc_id % 3) || ':ch' || substr(sha256(doc_id::VARCHAR), 1, 8)"
FORMS = f"""rd AS (SELECT doc_id, source, {CHUNK_SQL} AS chunk FROM documents),
rr AS (SELECT query_id AS task_id, route, rank, chunk AS ref FROM routes JOIN rd USING (doc_id)),
rq AS (SELECT task_id, CASE doc_id % 4 WHEN 0 THEN source || '/' || doc_id || '.md' WHEN 1 THEN split_part(chunk, ':ch', 1) ELSE chunk END AS ref, grade, doc_id * 2 AS place FROM qrels JOIN rd ON qrels.ref = doc_id
 UNION ALL SELECT task_id, source || '/' || doc_id || '.md' AS ref, 1 AS grade, doc_id * 2 + 1 AS place FROM qrels JOIN rd ON qrels.ref = doc_id WHERE doc_id % 2 = 1),
rl AS (SELECT task_id, ref, max(grade) AS grade, min(place) AS place FROM rq GROUP BY ALL),
rg AS (SELECT DISTINCT task_id, place // 2 % 5 AS group_no, ref FROM rq),
rm AS (SELECT r.task_id, r.route, r.rank, l.ref, l.grade, l.place FROM rr r JOIN rl l ON r.task_id = l.task_id AND CASE WHEN contains(l.ref, '#') THEN r.ref = l.ref OR starts_with(r.ref, l.ref || ':ch') ELSE split_part(r.ref, '#', 1) = l.ref END)"""


def chunk() -> Column:
    return F.concat("source", F.lit("/"), F.col("doc_id").cast("string"), F.lit(".md#e"), (F.col("doc_id") % 3).cast("string"), F.lit(":ch"), F.substring(F.sha2(F.col("doc_id").cast("string"), 256), 1, 8))


@query(f"""WITH RECURSIVE {ROUTES}, {QRELS}, {FORMS},
ranked AS MATERIALIZED (SELECT task_id, route, rank, list(struct_pack(ref := ref, grade := grade) ORDER BY grade DESC, place) AS ms FROM rm WHERE rank <= 10 AND grade > 0 GROUP BY ALL),
fold AS (SELECT task_id, route, 0::BIGINT AS rank, []::VARCHAR[] AS used, 0::DOUBLE AS dcg FROM (SELECT DISTINCT task_id, route FROM ranked)
 UNION ALL SELECT task_id, route, rank, CASE WHEN p IS NULL THEN used ELSE list_append(used, p.ref) END, dcg + CASE WHEN p IS NULL THEN 0 ELSE (pow(2.0, p.grade) - 1) / log2(rank + 1) END
 FROM (SELECT f.task_id, f.route, f.rank + 1 AS rank, f.used, f.dcg, list_filter(coalesce(ms, []), lambda m: NOT list_contains(f.used, m.ref))[1] AS p FROM fold f LEFT JOIN ranked r ON r.task_id = f.task_id AND r.route = f.route AND r.rank = f.rank + 1 WHERE f.rank < 10)),
dcg AS (SELECT task_id, route, dcg FROM fold WHERE rank = 10),
ideal AS (SELECT task_id, count(*) AS relevant, sum((pow(2.0, grade) - 1) / log2(i + 1)) FILTER (i <= 10) AS idcg FROM (SELECT task_id, grade, row_number() OVER (PARTITION BY task_id ORDER BY grade DESC, place) AS i FROM rl WHERE grade > 0) GROUP BY 1),
one AS (SELECT task_id, route, rank, arg_min(ref, (place, ref)) AS ref FROM rm WHERE rank <= 10 AND grade > 0 GROUP BY ALL),
new AS (SELECT * FROM one QUALIFY row_number() OVER (PARTITION BY task_id, route, ref ORDER BY rank) = 1),
ap AS (SELECT task_id, route, sum(h / rank) AS ap FROM (SELECT *, row_number() OVER (PARTITION BY task_id, route ORDER BY rank) AS h FROM new) GROUP BY ALL),
fst AS (SELECT task_id, route, min(rank) AS first FROM rm GROUP BY ALL), need AS (SELECT task_id, count(DISTINCT group_no) AS groups FROM rg GROUP BY 1),
rea AS (SELECT m.task_id, route, count(DISTINCT group_no) AS reached FROM rm m JOIN rg g ON m.task_id = g.task_id AND m.ref = g.ref WHERE rank <= 10 GROUP BY ALL),
ret AS (SELECT task_id, route, count(*) AS returned FROM rr WHERE rank <= 10 GROUP BY ALL),
t AS (SELECT * FROM (SELECT task_id FROM rr UNION SELECT task_id FROM rg) CROSS JOIN (SELECT DISTINCT route FROM rr))
SELECT task_id, route, round(CASE WHEN groups IS NULL THEN CASE WHEN returned IS NULL THEN 1 ELSE 0 END ELSE coalesce(reached, 0) / groups END, 6)::DOUBLE AS recall,
 round(CASE WHEN groups IS NOT NULL AND first IS NOT NULL THEN 1.0 / first ELSE 0 END, 6)::DOUBLE AS mrr, round(CASE WHEN idcg > 0 THEN coalesce(dcg, 0) / idcg ELSE 0 END, 6)::DOUBLE AS ndcg, round(CASE WHEN relevant > 0 THEN coalesce(ap, 0) / relevant ELSE 0 END, 6)::DOUBLE AS map
FROM t LEFT JOIN fst USING (task_id, route) LEFT JOIN rea USING (task_id, route) LEFT JOIN ap USING (task_id, route) LEFT JOIN ret USING (task_id, route) LEFT JOIN dcg USING (task_id, route) LEFT JOIN need USING (task_id) LEFT JOIN ideal USING (task_id)""")
def reference_metrics(spark: SparkSession, d: str) -> DataFrame:
    """Recall by groups, reciprocal rank, graded gain and precision of each item and route over chunk references."""
    docs = table(spark, d, "documents").select("doc_id", "source", chunk().alias("chunk"))
    runs = stored(routes(spark, d).join(docs, "doc_id").select(F.col("query_id").alias("task_id"), "route", "rank", F.col("chunk").alias("ref")), "chunk-runs")
    good = stored(qrels(spark, d).withColumnRenamed("ref", "doc_id").join(docs, "doc_id"), "chunk-qrels")
    n, file = F.col("doc_id"), F.concat("source", F.lit("/"), F.col("doc_id").cast("string"), F.lit(".md"))
    form = F.when(n % 4 == 0, file).when(n % 4 == 1, F.substring_index("chunk", ":ch", 1)).otherwise(F.col("chunk"))
    own = good.select("task_id", form.alias("ref"), "grade", (n * 2).alias("place"))
    whole = good.where(n % 2 == 1).select("task_id", file.alias("ref"), F.lit(1).alias("grade"), (n * 2 + 1).alias("place"))
    expected = own.unionByName(whole)
    groups = expected.select("task_id", (F.floor(F.col("place") / 2) % 5).alias("group_no"), "ref")
    return R.reference_metrics(runs, expected, groups, ["content", "fields"], 10)
