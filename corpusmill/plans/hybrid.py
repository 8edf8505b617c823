"""Words and vectors over one corpus: every hundredth document asks with its first words and its own embedding."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusmill.operators import fusion, hybrid, vectors
from corpusmill.operators.lexical import query_tokens
from corpusmill.plans.registry import query
from corpusmill.plans.retrieval import FIELDS, TOKENS_SQL, field_terms
from corpusmill.session import stored
from corpusmill.sources.tables import table

GATES = hybrid.Gates(coverage=0.6, cosine=0.15)
#: How questions are put. One in three asks for a topic, one in seven is a name that stands nowhere.
TOPIC_WORD, NAME = "哪些", "zz"
FIRST = r"array_to_string(string_split(regexp_replace(trim(text), '\s+', ' ', 'g'), ' ')[1:8], ' ')"
QUESTIONS = f"""qs AS (SELECT doc_id AS query_id, CASE WHEN doc_id % 700 = 100 THEN '{NAME}' || (doc_id + 900000) WHEN doc_id % 300 = 0 THEN '{TOPIC_WORD} ' || {FIRST} ELSE {FIRST} END AS text FROM documents WHERE doc_id % 100 = 0),
qt AS (SELECT query_id, text, list_concat({TOKENS_SQL.format(c="text")}, CASE WHEN starts_with(text, '{TOPIC_WORD}') THEN ['{TOPIC_WORD}'] ELSE [] END) AS toks, starts_with(text, '{TOPIC_WORD}') AS topic, starts_with(text, '{NAME}9') AS opaque FROM qs),
qw AS (SELECT query_id, unnest(toks) AS token FROM qt)"""
HYBRID = f"""{FIELDS}, {QUESTIONS}, nd AS (SELECT count(*) AS n FROM documents),
hits AS (SELECT query_id, token, doc_id, weight FROM posting JOIN qw USING (token)),
own AS (SELECT query_id, doc_id, 1 AS part, row_number() OVER (PARTITION BY query_id ORDER BY sum(weight) DESC, doc_id) AS rank FROM hits GROUP BY query_id, doc_id QUALIFY rank <= 40),
hdf AS (SELECT query_id, token, count(*) AS df FROM hits GROUP BY ALL),
ps AS (SELECT query_id, doc_id, round(sum(weight * (ln((n + 1) / (df + 1)) + 1)), 4) AS score, count(*) AS matched FROM hits JOIN hdf USING (query_id, token) JOIN qt USING (query_id), nd WHERE topic GROUP BY ALL),
par AS (SELECT query_id, doc_id, 0 AS part, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, matched DESC, doc_id) AS rank FROM ps QUALIFY rank <= 120),
fst AS (SELECT query_id, doc_id, min((part, rank)) AS place FROM (SELECT * FROM own UNION ALL SELECT * FROM par) GROUP BY ALL),
placed AS (SELECT query_id, doc_id, row_number() OVER (PARTITION BY query_id ORDER BY place) AS rank FROM fst),
cov AS (SELECT query_id, count(DISTINCT token) AS held, count(DISTINCT token) FILTER (length(token) >= 3) AS held_long FROM placed JOIN hits USING (query_id, doc_id) WHERE rank <= 3 GROUP BY 1),
need AS (SELECT query_id, count(*) AS n, count(*) FILTER (length(token) >= 3) AS n_long FROM qw GROUP BY 1),
unit AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings WHERE list_inner_product(embedding, embedding) > 0),
jd AS (SELECT qt.query_id, opaque, topic, u.e IS NOT NULL AS vectored, qt.query_id IN (SELECT query_id FROM placed) AS found, CASE WHEN coalesce(held_long, 0) < n_long THEN 0 ELSE round(coalesce(held, 0) / n, 6) END AS coverage
 FROM qt LEFT JOIN need USING (query_id) LEFT JOIN cov USING (query_id) LEFT JOIN unit u ON u.vec_id = qt.query_id),
jd2 AS (SELECT *, found AND coalesce(coverage, 0) < {GATES.coverage} AS thin FROM jd), jd3 AS (SELECT *, opaque AND (NOT found OR thin) AS skip FROM jd2),
vs AS (SELECT q.query_id, v.vec_id AS doc_id, round(list_cosine_similarity(q.e, v.e), 6) AS score FROM (SELECT jd3.query_id, e FROM jd3 JOIN unit ON vec_id = query_id WHERE NOT skip) q, (SELECT * FROM unit WHERE vec_id IN (SELECT doc_id FROM documents)) v),
vr AS (SELECT query_id, 'vector' AS route, doc_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM vs WHERE score > 0 QUALIFY rank <= 40),
hr AS (SELECT query_id, 'lexical' AS route, doc_id, rank FROM placed WHERE query_id NOT IN (SELECT query_id FROM jd3 WHERE thin) UNION ALL SELECT query_id, route, doc_id, rank FROM vr WHERE score >= {GATES.cosine})"""


def questions(spark: SparkSession, d: str) -> DataFrame:
    """(query_id, text, unit)."""
    n = F.col("doc_id")
    first = F.array_join(F.slice(F.split(F.regexp_replace(F.trim("text"), r"\s+", " "), " "), 1, 8), " ")
    asked = F.when(n % 700 == 100, F.concat(F.lit(NAME), (n + 900000).cast("string"))).when(n % 300 == 0, F.concat(F.lit(TOPIC_WORD + " "), first)).otherwise(first)
    docs = table(spark, d, "documents").where("doc_id % 100 = 0").select(n.alias("query_id"), asked.alias("text"))
    own = vectors.normalised(table(spark, d, "embeddings").where("vec_id % 100 = 0")).select(F.col("vec_id").alias("query_id"), "unit")
    return docs.join(own, "query_id", "left")


def corpus_vectors(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("vec_id"))
    return vectors.normalised(table(spark, d, "embeddings")).join(docs, "vec_id", "left_semi").select("vec_id", "unit")


def hybrid_routes(spark: SparkSession, d: str, gates: hybrid.Gates = GATES) -> tuple[DataFrame, DataFrame, DataFrame]:
    asked = stored(questions(spark, d), "hybrid-questions")  # else each reader cuts every document's text into tokens before it looks at the id
    tokens = query_tokens(asked.select("query_id", "text"))
    n = table(spark, d, "documents").agg(F.count("*").alias("n"))
    return (asked, *hybrid.collect_routes(asked, field_terms(spark, d), tokens, n, corpus_vectors(spark, d), gates))


@query(f"""WITH {HYBRID}, n AS (SELECT query_id, route, count(*) AS rows FROM hr GROUP BY ALL)
SELECT query_id, route, CASE WHEN route = 'lexical' THEN CASE WHEN thin THEN 'coverage_below' ELSE '' END WHEN skip THEN 'identifier_lexical_miss_skip' WHEN NOT vectored THEN 'question_without_vector' ELSE '' END AS reason, coalesce(rows, 0) AS rows
FROM jd3 CROSS JOIN (VALUES ('lexical'), ('vector')) r(route) LEFT JOIN n USING (query_id, route)""")
def hybrid_route_status(spark: SparkSession, d: str) -> DataFrame:
    """What each route gave each question, and why one was left out."""
    return hybrid_routes(spark, d)[2].select("query_id", "route", "reason", "rows")


@query(f"""WITH {HYBRID}, s AS (SELECT query_id, doc_id, round(sum(1.0::DOUBLE / (60 + rank)), 6) AS score, string_agg(route, '|' ORDER BY route) AS routes FROM hr GROUP BY ALL)
SELECT query_id, doc_id, score, routes, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id)::INT AS rank FROM s QUALIFY rank <= 8""")
def hybrid_search(spark: SparkSession, d: str) -> DataFrame:
    """Words and vectors fused by reciprocal rank, with the routes that found each document."""
    asked, routes, _ = hybrid_routes(spark, d)
    shown = hybrid.displayed(routes, asked, "on", "off", 8)
    by = routes.groupBy("query_id", "doc_id").agg(F.array_join(F.array_sort(F.collect_list("route")), "|").alias("routes"))
    return shown.join(by, ["query_id", "doc_id"]).select("query_id", "doc_id", "score", "routes", "rank")


@query(f"""WITH {HYBRID}, d AS (SELECT query_id, CASE WHEN topic THEN 'guarded_hybrid_fallback' ELSE 'lexical' END AS display FROM qt),
s AS (SELECT query_id, display, doc_id, round(sum(1.0::DOUBLE / (60 + rank)), 6) AS score FROM hr JOIN d USING (query_id) WHERE display <> 'lexical' OR route = 'lexical' GROUP BY ALL)
SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id)::INT AS rank FROM s QUALIFY rank <= 8""")
def hybrid_guarded_display(spark: SparkSession, d: str) -> DataFrame:
    """In shadow mode with the fallback on: vectors show for questions about meaning alone."""
    asked, routes, _ = hybrid_routes(spark, d)
    return hybrid.displayed(routes, asked, "shadow", "on", 8)


#: Weights of words and vectors in the sweep.
SWEEP = [("lexical", 1.0, 0.0), ("vector", 0.0, 1.0), ("equal", 1.0, 1.0), ("vector_1_25", 1.0, 1.25), ("vector_1_5", 1.0, 1.5), ("vector_2", 1.0, 2.0), ("lexical_0_5", 0.5, 1.0)]
SWEEP_SQL = ", ".join(f"('{v}', 'lexical', {a}::DOUBLE), ('{v}', 'vector', {b}::DOUBLE)" for v, a, b in SWEEP)


@query(f"""WITH {HYBRID}, w(variant, route, weight) AS (VALUES {SWEEP_SQL}),
s AS (SELECT variant, query_id, doc_id, round(sum(weight / (60 + rank)), 6) AS score FROM hr JOIN w USING (route) WHERE weight > 0 GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY variant, query_id ORDER BY score DESC, doc_id) AS rank FROM s),
t AS (SELECT l.vec_id AS query_id, d.vec_id AS ref FROM embeddings l JOIN embeddings d USING (label) JOIN documents ON doc_id = d.vec_id WHERE l.vec_id IN (SELECT query_id FROM qt) AND l.vec_id <> d.vec_id)
SELECT variant, count(DISTINCT r.query_id) AS questions, count(*) FILTER (r.doc_id = r.query_id AND rank = 1) AS itself_first, round(count(t.ref)::DOUBLE / count(*), 6) AS same_label FROM r LEFT JOIN t ON t.query_id = r.query_id AND t.ref = r.doc_id WHERE rank <= 10 GROUP BY 1""")
def hybrid_weight_sweep(spark: SparkSession, d: str) -> DataFrame:
    """Weights of words and vectors: how often the asking document comes first, and the share of the ten best with its label."""
    _, routes, _ = hybrid_routes(spark, d)
    weights = F.explode(F.array(*[F.struct(F.lit(v).alias("variant"), F.lit(r).alias("route"), F.lit(w).alias("weight")) for v, a, b in SWEEP for r, w in (("lexical", a), ("vector", b))])).alias("w")
    ranked = fusion.reciprocal_rank_fusion(routes.withColumnRenamed("doc_id", "key"), 10, spark.range(1).select(weights).select("w.*"))
    labels = table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), "label")
    own = ranked.join(labels.select(F.col("id").alias("query_id"), F.col("label").alias("asked")), "query_id", "left").join(labels.withColumnRenamed("id", "key"), "key", "left")
    same = (F.col("asked") == F.col("label")) & (F.col("key") != F.col("query_id"))
    return own.groupBy("variant").agg(
        F.countDistinct("query_id").alias("questions"), F.count_if((F.col("key") == F.col("query_id")) & (F.col("rank") == 1)).alias("itself_first"), F.round(F.count_if(same) / F.count("*"), 6).alias("same_label"),
    )
