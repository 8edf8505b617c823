"""Retrieval queries: lexical, vector, fusion, text search, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corpusmill.functions import text as T
from corpusmill.operators import fusion, lexical, ranking, vectors
from corpusmill.operators.hybrid import coverage
from corpusmill.plans.registry import query
from corpusmill.session import stored
from corpusmill.sources.tables import table

ASKED = "the and attion of thanedble"
TOKENS_SQL = r"list_distinct(list_transform(regexp_extract_all({c}, '[A-Za-z0-9_]+(?:[.:-][A-Za-z0-9_]+)*'), lambda t: lower(t)))"
TOK = TOKENS_SQL.format(c="text")
CONTENT = f"content AS (SELECT doc_id, unnest({TOK}) AS token FROM documents)"
WANTED = f"wanted AS (SELECT item_id AS query_id, unnest({TOK}) AS token FROM benchmark)"
FIELDS = f"""fields AS (
  SELECT doc_id, 'content' AS field, 1.0::DOUBLE AS w, unnest({TOK}) AS token FROM documents UNION ALL
  SELECT doc_id, 'title', 3.0, unnest({TOKENS_SQL.format(c="split_part(text, chr(10), 1)")}) FROM documents UNION ALL
  SELECT doc_id, 'tags', 2.0, unnest({TOKENS_SQL.format(c="lang")}) FROM documents UNION ALL
  SELECT doc_id, 'path', 2.0, unnest({TOKENS_SQL.format(c="source || '/' || doc_id")}) FROM documents
), posting AS (SELECT token, doc_id, sum(w) AS weight, string_agg(field, '|' ORDER BY field) AS fields FROM fields GROUP BY ALL)"""


def asked(spark: SparkSession, text: str = ASKED) -> DataFrame:
    return spark.range(1).select(F.lit(0).alias("query_id"), F.lit(text).alias("text"))


def items(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), "text")


def content(spark: SparkSession, d: str) -> DataFrame:
    return lexical.content_postings(table(spark, d, "documents")).withColumn("weight", F.lit(1.0))


def content_terms(spark: SparkSession, d: str) -> DataFrame:
    return ranking.document_terms(table(spark, d, "documents").select("doc_id", F.col("text").alias("content")), {"content": 1.0})


def as_notes(spark: SparkSession, d: str) -> DataFrame:
    return lexical.notes(table(spark, d, "documents")).withColumn("path", F.concat_ws("/", "source", "doc_id"))


def field_postings(spark: SparkSession, d: str) -> DataFrame:
    return lexical.postings(as_notes(spark, d))


def field_terms(spark: SparkSession, d: str) -> DataFrame:
    """The terms of each document by their fields, stored for the readers of one query."""
    return ranking.document_terms(as_notes(spark, d), lexical.FIELD_WEIGHTS)


@query(f"""WITH {CONTENT}, q AS (SELECT unnest({TOKENS_SQL.format(c=f"'{ASKED}'")}) AS token)
SELECT doc_id, count(*)::DOUBLE AS score, count(*) AS matched FROM content JOIN q USING (token)
GROUP BY doc_id ORDER BY score DESC, doc_id LIMIT 50""")
def lexical_topk(spark: SparkSession, d: str) -> DataFrame:
    held = F.array_intersect(T.index_tokens(F.col("text")), T.ranking_tokens(T.index_tokens(F.lit(ASKED))))
    found = table(spark, d, "documents").select("doc_id", F.size(held).cast("long").alias("matched")).where("matched > 0")
    return found.select("doc_id", F.col("matched").cast("double").alias("score"), "matched").orderBy(F.desc("score"), "doc_id").limit(50)


@query(f"""WITH {CONTENT}, {WANTED}, s AS (SELECT query_id, doc_id, count(*) AS matched FROM content JOIN wanted USING (token) GROUP BY ALL)
SELECT query_id, doc_id, matched, row_number() OVER (PARTITION BY query_id ORDER BY matched DESC, doc_id)::INT AS rank FROM s
QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY matched DESC, doc_id) <= 10""")
def lexical_batch_benchmark(spark: SparkSession, d: str) -> DataFrame:
    tokens = lexical.query_tokens(items(spark, d))
    return lexical.lexical_topk(content_terms(spark, d), tokens, 10, "content").select("query_id", "doc_id", "matched", "rank")


@query(f"""WITH {CONTENT}, {WANTED}, df AS (SELECT token, count(*) AS df FROM content GROUP BY 1), n AS (SELECT count(*) AS n FROM documents),
w AS (SELECT query_id, token, ln((n + 1) / (coalesce(df, 0) + 1)) + 1 AS idf FROM wanted LEFT JOIN df USING (token), n),
s AS (SELECT query_id, doc_id, round(sum(idf), 6) AS score, count(*) AS matched FROM content JOIN w USING (token) GROUP BY ALL)
SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id)::INT AS rank FROM s QUALIFY rank <= 10""")
def lexical_idf_rerank(spark: SparkSession, d: str) -> DataFrame:
    n = table(spark, d, "documents").agg(F.count("*").alias("n"))
    tokens = lexical.query_tokens(items(spark, d))
    out = lexical.lexical_idf_topk(content_terms(spark, d), tokens, n, 10)
    return out.select("query_id", "doc_id", "score", "matched", "rank")


@query(f"WITH {CONTENT} SELECT token, count(*) AS df FROM content GROUP BY token")
def doc_frequency(spark: SparkSession, d: str) -> DataFrame:
    return lexical.document_frequency(content(spark, d))


@query(f"""WITH {CONTENT}, df AS (SELECT token, count(*) AS df FROM content GROUP BY 1)
SELECT count(*) AS tokens, sum(df)::BIGINT AS postings, max(df) AS max_df, count(*) FILTER (df = 1) AS once, round(avg(df), 4) AS mean_df FROM df""")
def posting_stats(spark: SparkSession, d: str) -> DataFrame:
    df = lexical.document_frequency(content(spark, d))
    return df.agg(
        F.count("*").alias("tokens"), F.sum("df").alias("postings"), F.max("df").alias("max_df"),
        F.count_if(F.col("df") == 1).alias("once"), F.round(F.avg("df"), 4).alias("mean_df"),
    )


@query(f"WITH {FIELDS} SELECT token, doc_id, weight, fields FROM posting")
def field_weighted_postings(spark: SparkSession, d: str) -> DataFrame:
    return field_postings(spark, d)


@query(f"""WITH {FIELDS}, {WANTED}, s AS (SELECT query_id, doc_id, sum(weight) AS score, count(*) AS matched FROM posting JOIN wanted USING (token) GROUP BY ALL)
SELECT query_id, doc_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id)::INT AS rank FROM s QUALIFY rank <= 8""")
def field_weighted_topk(spark: SparkSession, d: str) -> DataFrame:
    tokens = lexical.query_tokens(items(spark, d))
    return lexical.lexical_topk(field_terms(spark, d), tokens, 8).select("query_id", "doc_id", "score", "rank")


@query(f"""WITH {FIELDS}, {WANTED}, n AS (SELECT count(DISTINCT source) AS n FROM documents),
e AS (SELECT query_id, source, token, max(weight) AS weight FROM posting JOIN wanted USING (token) JOIN documents USING (doc_id) GROUP BY ALL),
df AS (SELECT query_id, token, count(*) AS df FROM e GROUP BY ALL),
s AS (SELECT query_id, source, round(sum(weight * (ln((n + 1) / (df + 1)) + 1)), 4) AS score, count(*) AS matched FROM e JOIN df USING (query_id, token), n GROUP BY ALL)
SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, matched DESC, source)::INT AS rank FROM s QUALIFY rank <= 5""")
def parent_entry_topk(spark: SparkSession, d: str) -> DataFrame:
    """Entries (here sources) by the best weight of each token times its idf among entries. An entry's best weights are
    taken before questions are looked at."""
    docs = table(spark, d, "documents")
    tokens = lexical.query_tokens(items(spark, d))
    asked = tokens.select("query_id", F.xxhash64("token").alias("term"), "token")
    held = field_terms(spark, d).join(docs.select("doc_id", "source"), "doc_id").select("source", F.explode(F.arrays_zip("terms", "weights")).alias("t"))
    of_source = held.select("source", F.col("t.terms").alias("term"), F.col("t.weights").cast("double").alias("weight")).join(asked.select("term").distinct(), "term", "left_semi")
    best = of_source.groupBy("source", "term").agg(F.max("weight").alias("weight")).join(asked, "term").select("query_id", "source", "token", "weight")
    df = best.groupBy("query_id", "token").agg(F.count("*").alias("df"))
    n = docs.agg(F.countDistinct("source").alias("n"))
    total = (
        best.join(df, ["query_id", "token"])
        .join(F.broadcast(n))
        .groupBy("query_id", "source")
        .agg(F.round(F.sum(F.col("weight") * lexical.idf(F.col("df"), F.col("n"))), 4).alias("score"), F.count("*").alias("matched"))
    )
    return lexical.top_k(total, 5, ["query_id"], F.desc("score"), F.desc("matched"), "source")


@query(f"""WITH {CONTENT}, {WANTED}, nt AS (SELECT query_id, count(*) AS n_tokens FROM wanted GROUP BY 1),
s AS (SELECT query_id, doc_id, count(*) AS matched FROM content JOIN wanted USING (token) GROUP BY ALL),
top AS (SELECT query_id, doc_id FROM s QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY matched DESC, doc_id) <= 3),
cov AS (SELECT query_id, count(DISTINCT token) AS covered, count(DISTINCT token) FILTER (length(token) >= 3) AS ids FROM top JOIN content USING (doc_id) JOIN wanted USING (query_id, token) GROUP BY 1),
ni AS (SELECT query_id, count(*) FILTER (length(token) >= 3) AS n_ids FROM wanted GROUP BY 1)
SELECT query_id, CASE WHEN coalesce(ids, 0) < n_ids THEN 0.0::DOUBLE ELSE round(coalesce(covered, 0) / n_tokens, 6) END AS confidence
FROM nt JOIN ni USING (query_id) LEFT JOIN cov USING (query_id)""")
def lexical_confidence(spark: SparkSession, d: str) -> DataFrame:
    """Share of query tokens found in the best three documents; 0 if an identifier is missing."""
    tokens = lexical.query_tokens(items(spark, d))
    terms = content_terms(spark, d)
    top = lexical.lexical_topk(terms, tokens, 3, "content").select("query_id", "doc_id")
    return coverage(top, terms, tokens).withColumnRenamed("coverage", "confidence")


@query(f"""WITH {CONTENT}, n AS (SELECT count(*) AS n FROM documents), df AS (SELECT token, count(*) AS df FROM content GROUP BY 1),
q AS (SELECT token, ln((n + 1) / (df + 1)) + 1 AS idf FROM (SELECT token, df FROM df WHERE token IN ('thanedble', 'attion', 'the')), n),
s AS (SELECT doc_id, count(*)::DOUBLE AS score, sum(idf) AS m FROM content JOIN q USING (token) GROUP BY 1)
SELECT doc_id, score, round(m / (SELECT sum(idf) FROM q), 6) AS coverage FROM s ORDER BY score DESC, coverage DESC, doc_id DESC LIMIT 20""")
def lexical_rescue_rank(spark: SparkSession, d: str) -> DataFrame:
    """The rescue order: score, coverage by idf, reference, all descending."""
    n = table(spark, d, "documents").agg(F.count("*").alias("n"))
    tokens = lexical.query_tokens(asked(spark, "thanedble attion the")).select("token")
    posting = content(spark, d).join(F.broadcast(tokens), "token", "left_semi")
    weights = lexical.document_frequency(posting).join(tokens, "token", "left_semi").join(F.broadcast(n)).select("token", lexical.idf(F.col("df"), F.col("n")).alias("idf"))
    total = weights.agg(F.sum("idf").alias("total"))
    hits = posting.join(weights, "token").groupBy("doc_id").agg(F.sum("weight").alias("score"), F.sum("idf").alias("m"))
    return (
        hits.join(F.broadcast(total))
        .select("doc_id", "score", F.round(F.col("m") / F.col("total"), 6).alias("coverage"))
        .orderBy(F.desc("score"), F.desc("coverage"), F.desc("doc_id"))
        .limit(20)
    )


COSINE = "round(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 6)"


def asked_vectors(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "embeddings").where("vec_id % 100 = 0")
    return vectors.normalised(rows).where("unit IS NOT NULL").select(F.col("vec_id").alias("query_id"), "unit")


@query(f"""WITH s AS (SELECT a.vec_id AS query_id, b.vec_id, {COSINE} AS score FROM embeddings a, embeddings b WHERE a.vec_id % 100 = 0)
SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INT AS rank FROM s WHERE score > 0 QUALIFY rank <= 20""")
def vector_batch(spark: SparkSession, d: str) -> DataFrame:
    """The nearest vectors of every one whose id is divisible by 100."""
    every = vectors.normalised(table(spark, d, "embeddings")).where("unit IS NOT NULL")
    return vectors.cosine_topk(asked_vectors(spark, d), every, 20)



@query(f"""WITH s AS (SELECT a.vec_id AS query_id, b.vec_id, {COSINE} AS score FROM embeddings a, embeddings b WHERE a.vec_id % 100 = 0 AND b.label IN (1, 3, 5))
SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INT AS rank FROM s WHERE score > 0.1 QUALIFY rank <= 10""")
def vector_topk_by_scope(spark: SparkSession, d: str) -> DataFrame:
    """The scope filter stands before the ranking."""
    scope = table(spark, d, "embeddings").where(F.col("label").isin(1, 3, 5))
    every = vectors.normalised(scope).where("unit IS NOT NULL")
    return vectors.cosine_topk(asked_vectors(spark, d), every, 10, 0.1)



ROUTES = f"""{FIELDS}, {WANTED}, {CONTENT},
a AS (SELECT query_id, 'content' AS route, doc_id, row_number() OVER (PARTITION BY query_id ORDER BY count(*) DESC, doc_id) AS rank FROM content JOIN wanted USING (token) GROUP BY query_id, doc_id QUALIFY rank <= 40),
b AS (SELECT query_id, 'fields' AS route, doc_id, row_number() OVER (PARTITION BY query_id ORDER BY sum(weight) DESC, doc_id) AS rank FROM posting JOIN wanted USING (token) GROUP BY query_id, doc_id QUALIFY rank <= 40),
routes AS (SELECT * FROM a UNION ALL SELECT * FROM b)"""


def routes(spark: SparkSession, d: str) -> DataFrame:
    """(query_id, route, doc_id, rank): two routes of 40 candidates for each benchmark item."""
    tokens = stored(lexical.query_tokens(items(spark, d)), "question-tokens")
    terms = ranking.asked_terms(as_notes(spark, d), lexical.FIELD_WEIGHTS, tokens)
    a = lexical.lexical_topk(terms, tokens, 40, "content").withColumn("route", F.lit("content"))
    b = lexical.lexical_topk(terms, tokens, 40).withColumn("route", F.lit("fields"))
    return stored(a.unionByName(b).select("query_id", "route", "doc_id", "rank"), "routes")


@query(f"""WITH {ROUTES}, s AS (SELECT query_id, doc_id, round(sum(1.0::DOUBLE / (60 + rank)), 6) AS score FROM routes GROUP BY ALL)
SELECT query_id, doc_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id)::INT AS rank FROM s QUALIFY rank <= 8""")
def rrf_fuse(spark: SparkSession, d: str) -> DataFrame:
    ranked = routes(spark, d).withColumnRenamed("doc_id", "key")
    return fusion.reciprocal_rank_fusion(ranked, 8).withColumnRenamed("key", "doc_id")


#: The weights of the sweep.
VARIANTS = [
    ("lexical", 1.0, 0.0), ("vector", 0.0, 1.0), ("equal", 1.0, 1.0), ("vector_1_25", 1.0, 1.25),
    ("vector_1_5", 1.0, 1.5), ("vector_2", 1.0, 2.0), ("lexical_0_5", 0.5, 1.0),
]
VARIANT_SQL = ", ".join(f"('{v}', 'content', {a}::DOUBLE), ('{v}', 'fields', {b}::DOUBLE)" for v, a, b in VARIANTS)


@query(f"""WITH {ROUTES}, w(variant, route, weight) AS (VALUES {VARIANT_SQL}),
s AS (SELECT variant, query_id, doc_id, round(sum(weight / (60 + rank)), 6) AS score FROM routes JOIN w USING (route) WHERE weight > 0 GROUP BY ALL)
SELECT *, row_number() OVER (PARTITION BY variant, query_id ORDER BY score DESC, doc_id)::INT AS rank FROM s QUALIFY rank <= 10""")
def weighted_rrf_sweep(spark: SparkSession, d: str) -> DataFrame:
    rows = [(v, r, w) for v, a, b in VARIANTS for r, w in (("content", a), ("fields", b))]
    weights = spark.createDataFrame(rows, "variant string, route string, weight double")
    ranked = routes(spark, d).withColumnRenamed("doc_id", "key")
    return fusion.reciprocal_rank_fusion(ranked, 10, weights).withColumnRenamed("key", "doc_id")


@query(f"""WITH {ROUTES}, e AS (SELECT query_id, route, source AS key, min(rank) AS place FROM routes JOIN documents USING (doc_id) GROUP BY ALL),
r AS (SELECT query_id, key, row_number() OVER (PARTITION BY query_id, route ORDER BY place, key) AS rank FROM e),
s AS (SELECT query_id, key, round(sum(1.0::DOUBLE / (60 + rank)), 6) AS score FROM r GROUP BY ALL)
SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, key)::INT AS rank FROM s QUALIFY rank <= 8""")
def rrf_fuse_entries(spark: SparkSession, d: str) -> DataFrame:
    """Ranks among the first of each entry (here a source) in its route, then fused."""
    rows = routes(spark, d).join(table(spark, d, "documents").select("doc_id", F.col("source").alias("key")), "doc_id")
    return fusion.reciprocal_rank_fusion(fusion.route_ranks(rows.withColumn("heading_only", F.lit(False))), 8)


@query(f"""WITH {ROUTES}, c AS (SELECT query_id, doc_id, source, rank FROM a JOIN documents USING (doc_id)),
p AS (SELECT *, row_number() OVER (PARTITION BY query_id, source ORDER BY rank) > 1 AS repeat FROM c)
SELECT query_id, doc_id, source, row_number() OVER (PARTITION BY query_id ORDER BY repeat, rank)::INT AS rank FROM p QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY repeat, rank) <= 8""")
def diversify_documents(spark: SparkSession, d: str) -> DataFrame:
    rows = routes(spark, d).where("route = 'content'").join(table(spark, d, "documents").select("doc_id", "source"), "doc_id")
    return fusion.diversified(rows, "source", 8).select("query_id", "doc_id", "source", "rank")


@query(f"""WITH {ROUTES}, u AS (SELECT query_id, doc_id, route, rank FROM routes QUALIFY row_number() OVER (PARTITION BY query_id, doc_id ORDER BY route, rank) = 1)
SELECT query_id, doc_id, route FROM u""")
def union_first_wins(spark: SparkSession, d: str) -> DataFrame:
    """The union of the routes; the first route that has a document keeps it."""
    first = routes(spark, d).groupBy("query_id", "doc_id").agg(F.min(F.struct("route", "rank")).alias("m"))
    return first.select("query_id", "doc_id", "m.route")


@query("""SELECT conv_id, turn, lag(turn) OVER w AS before_turn, lead(turn) OVER w AS after_turn,
coalesce(length(lag(text) OVER w), 0) + length(text) + coalesce(length(lead(text) OVER w), 0) AS context_chars
FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)""")
def neighbor_expand(spark: SparkSession, d: str) -> DataFrame:
    w = Window.partitionBy("conv_id").orderBy("turn")
    size = lambda c: F.coalesce(F.length(c), F.lit(0)).cast("long")
    return table(spark, d, "conversations").select(
        "conv_id", "turn", F.lag("turn").over(w).alias("before_turn"), F.lead("turn").over(w).alias("after_turn"),
        (size(F.lag("text").over(w)) + size(F.col("text")) + size(F.lead("text").over(w))).alias("context_chars"),
    )


@query("""WITH t AS (SELECT doc_id, lower(text) AS low, lower(source) AS name FROM documents)
SELECT doc_id, (CASE WHEN contains(name, 'th') THEN 6 ELSE 4 END + CASE WHEN contains(name, 'ion') THEN 6 ELSE 4 END)::INT AS score,
least(strpos(low, 'th'), strpos(low, 'ion'))::INT AS first_at, len(string_split(low[1:least(strpos(low, 'th'), strpos(low, 'ion'))], chr(10)))::INT AS line
FROM t WHERE contains(low, 'th') AND contains(low, 'ion')""")
def and_text_score(spark: SparkSession, d: str) -> DataFrame:
    """All terms have to occur: 6 for one in the name, else 4; place and line of the first."""
    terms = ["th", "ion"]
    low = table(spark, d, "documents").select("doc_id", F.lower("text").alias("low"), F.lower("source").alias("name"))
    for t in terms:
        low = low.where(F.contains("low", F.lit(t)))
    score = sum((F.when(F.contains("name", F.lit(t)), 6).otherwise(4) for t in terms), F.lit(0))
    at = F.least(*[F.locate(t, F.col("low")) for t in terms])
    line = F.size(F.split(F.substr("low", F.lit(1), at), "\n"))
    return low.select("doc_id", score.alias("score"), at.alias("first_at"), line.alias("line"))


@query("""WITH t AS (SELECT doc_id, lower(split_part(text, chr(10), 1)) AS title, lower(lang) AS tags, lower(text) AS body FROM documents)
SELECT doc_id, (CASE WHEN contains(title, 'tion') THEN 0 WHEN contains(tags, 'tion') THEN 1 ELSE 2 END)::INT AS place,
((length(body) - length(replace(body, 'tion', ''))) / 4)::BIGINT AS hits FROM t
WHERE contains(title, 'tion') OR contains(tags, 'tion') OR contains(body, 'tion')
ORDER BY place, hits DESC, doc_id LIMIT 20""")
def keyword_rank_search(spark: SparkSession, d: str) -> DataFrame:
    """Title before tag before body, then hits, then path."""
    kw = "tion"
    t = lexical.notes(table(spark, d, "documents")).select("doc_id", F.lower("title").alias("title"), F.lower("tags").alias("tags"), F.lower("content").alias("body"))
    has = lambda c: F.contains(c, F.lit(kw))
    place = F.when(has("title"), 0).when(has("tags"), 1).otherwise(2)
    found = t.where(has("title") | has("tags") | has("body"))
    return found.select("doc_id", place.alias("place"), T.occurrences(F.col("body"), kw).alias("hits")).orderBy("place", F.desc("hits"), "doc_id").limit(20)


@query(r"""SELECT doc_id, CASE WHEN strpos(lower(text), 'that') > 0 THEN trim(regexp_replace(
substr(text, greatest(strpos(lower(text), 'that') - 40, 1), 84), '\s+', ' ', 'g')) ELSE '' END AS snippet FROM documents""")
def snippets(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", T.snippet(F.col("text"), "that").alias("snippet"))


@query("""SELECT doc_id, CASE WHEN length(text) > 1200 THEN substr(text, 1, 960) || chr(10) || '…[truncated ' || (length(text) - 1200) || ' chars]…' || chr(10) || right(text, 240) ELSE text END AS content FROM documents""")
def truncated_recall(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", T.head_and_tail(F.col("text"), 1200, 240).alias("content"))


@query(f"""WITH q AS (SELECT item_id, {TOK} AS t FROM benchmark)
SELECT item_id, len(t)::INT AS n_tokens, (len(list_filter(t, lambda x: regexp_full_match(x, '.*[0-9].*'))) > 0) AS identifier, list_sort(t)[1] AS first_token FROM q""")
def query_profile(spark: SparkSession, d: str) -> DataFrame:
    """Flags by which a query's route is chosen."""
    t = table(spark, d, "benchmark").select("item_id", T.index_tokens(F.col("text")).alias("t"))
    return t.select("item_id", F.size("t").alias("n_tokens"), F.exists("t", lambda x: x.rlike("[0-9]")).alias("identifier"), F.array_sort("t")[0].alias("first_token"))
