"""Audits, picks and records that join small rules to the tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusmill.functions import text as T
from corpusmill.operators import lexical
from corpusmill.plans.registry import query
from corpusmill.plans.retrieval import ROUTES, TOKENS_SQL, content, items, routes
from corpusmill.sources.tables import table


@query("""SELECT source, arg_min(doc_id, (CASE lang WHEN 'en' THEN 0 WHEN 'de' THEN 1 WHEN 'fr' THEN 2 ELSE 3 END, doc_id)) AS doc_id FROM documents GROUP BY source""")
def language_pick(spark: SparkSession, d: str) -> DataFrame:
    """The first document of the best language tier."""
    tier = F.when(F.col("lang") == "en", 0).when(F.col("lang") == "de", 1).when(F.col("lang") == "fr", 2).otherwise(3)
    return table(spark, d, "documents").groupBy("source").agg(F.min_by("doc_id", F.struct(tier, "doc_id")).alias("doc_id"))


@query(r"""WITH t AS (SELECT doc_id, regexp_extract_all(split_part(text, chr(10), 1), '[A-Za-z]{2,}') AS w, lower(substr(text, strpos(text, chr(10)) + 1)) AS body FROM documents WHERE contains(text, chr(10)))
SELECT doc_id, len(list_filter(w[1:5], lambda x: contains(body, lower(x)))) > 0 AS consistent FROM t""")
def title_consistency(spark: SparkSession, d: str) -> DataFrame:
    """Whether one of the title's first five words occurs in the body."""
    docs = table(spark, d, "documents").where(F.contains("text", F.lit("\n")))
    words = F.slice(F.regexp_extract_all(F.substring_index("text", "\n", 1), F.lit("[A-Za-z]{2,}"), 0), 1, 5)
    body = F.lower(F.substr("text", F.locate("\n", F.col("text")) + 1))
    return docs.select("doc_id", F.exists(words, lambda w: F.contains(body, F.lower(w))).alias("consistent"))


@query("""WITH n AS (SELECT max(doc_id) + 1 AS ids FROM documents), c AS (SELECT event_id, (event_id * 7919) % (ids + ids // 5) AS ref FROM events, n)
SELECT event_id, CASE WHEN doc_id IS NULL THEN 'unknown' WHEN toxic = 1 THEN 'forbidden' WHEN lang <> 'en' THEN 'scope' ELSE 'valid' END AS verdict
FROM c LEFT JOIN documents ON ref = doc_id LEFT JOIN labels USING (doc_id)""")
def citation_validity(spark: SparkSession, d: str) -> DataFrame:
    """Each cited reference, over all documents and a fifth more ids: known, allowed, in scope."""
    ids = table(spark, d, "documents").agg((F.max("doc_id") + 1).alias("ids"))
    cited = table(spark, d, "events").join(F.broadcast(ids)).select("event_id", ((F.col("event_id") * 7919) % (F.col("ids") + F.floor(F.col("ids") / 5))).alias("doc_id"))
    known = table(spark, d, "documents").select("doc_id", "lang").withColumn("known", F.lit(True))
    joined = cited.join(known, "doc_id", "left").join(table(spark, d, "labels"), "doc_id", "left")
    verdict = F.when(F.col("known").isNull(), "unknown").when(F.col("toxic") == 1, "forbidden").when(F.col("lang") != "en", "scope").otherwise("valid")
    return joined.select("event_id", verdict.alias("verdict"))


@query("""SELECT CASE WHEN o_orderstatus = 'F' THEN 'none' WHEN o_totalprice > 250000 THEN 'retrieval' WHEN o_orderpriority = '1-URGENT' THEN 'ranking' WHEN o_orderkey % 2 = 0 THEN 'generation' ELSE 'judgement' END AS cause, count(*) AS n FROM orders GROUP BY 1""")
def error_attribution(spark: SparkSession, d: str) -> DataFrame:
    """The first cause that fits, of five."""
    cause = (
        F.when(F.col("o_orderstatus") == "F", "none").when(F.col("o_totalprice") > 250000, "retrieval")
        .when(F.col("o_orderpriority") == "1-URGENT", "ranking").when(F.col("o_orderkey") % 2 == 0, "generation").otherwise("judgement")
    )
    return table(spark, d, "orders").groupBy(cause.alias("cause")).agg(F.count("*").alias("n"))


@query("""WITH t AS (SELECT l_orderkey, bool_and(l_linestatus = 'F') AS ready, count(*) AS deps FROM lineitem GROUP BY 1) SELECT o_orderkey, coalesce(ready, true) AS ready, coalesce(deps, 0) AS deps FROM orders LEFT JOIN t ON o_orderkey = l_orderkey WHERE o_orderstatus <> 'F'""")
def step_readiness(spark: SparkSession, d: str) -> DataFrame:
    """Open tasks all of whose dependencies are done."""
    deps = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.bool_and(F.col("l_linestatus") == "F").alias("r"), F.count("*").alias("c"))
    todo = table(spark, d, "orders").where("o_orderstatus <> 'F'").select("o_orderkey")
    return todo.join(deps, "o_orderkey", "left").select("o_orderkey", F.coalesce("r", F.lit(True)).alias("ready"), F.coalesce("c", F.lit(0)).cast("long").alias("deps"))


@query("""SELECT coalesce(nullif(regexp_extract(lower(split_part(text, chr(10), 1)), '[a-z]{3,}'), ''), 'none') AS first_tag, count(*) AS n, min(doc_id) AS example FROM documents GROUP BY 1""")
def case_library(spark: SparkSession, d: str) -> DataFrame:
    """Documents by their first tag, here the title's first word."""
    tag = F.nullif(F.regexp_extract(F.lower(F.substring_index("text", "\n", 1)), "[a-z]{3,}", 0), F.lit(""))
    return table(spark, d, "documents").groupBy(F.coalesce(tag, F.lit("none")).alias("first_tag")).agg(F.count("*").alias("n"), F.min("doc_id").alias("example"))


@query("""SELECT l_returnflag AS list_name, count(*) FILTER (l_linestatus = 'O') AS open_nodes, count(*) FILTER (l_linestatus = 'F') AS done_nodes, max(l_linenumber) AS depth FROM lineitem GROUP BY 1""")
def tree_counts(spark: SparkSession, d: str) -> DataFrame:
    """Open and done nodes of flattened trees."""
    return table(spark, d, "lineitem").groupBy(F.col("l_returnflag").alias("list_name")).agg(
        F.count_if(F.col("l_linestatus") == "O").alias("open_nodes"), F.count_if(F.col("l_linestatus") == "F").alias("done_nodes"), F.max("l_linenumber").alias("depth")
    )


@query("""SELECT item_id, count(doc_id) AS holders, min(doc_id) AS first_holder FROM benchmark b LEFT JOIN documents d ON contains(d.text, b.text) GROUP BY 1""")
def negative_label_conflicts(spark: SparkSession, d: str) -> DataFrame:
    """Documents that hold an item word for word: candidates by its rarest inner token, then checked."""
    asked = table(spark, d, "benchmark").select("item_id", F.col("text").alias("item"))
    inner = F.regexp_extract_all(F.regexp_replace("item", r"^\S*\s|\s\S*$", " "), F.lit(T.IDENTIFIER), 0)
    posting = content(spark, d).select("doc_id", "token")
    tokens = asked.select("item_id", F.explode(F.array_distinct(F.transform(inner, F.lower))).alias("token"))
    ranked = tokens.join(lexical.document_frequency(posting), "token", "left").withColumn("df", F.coalesce("df", F.lit(0)))
    rarest = ranked.groupBy("item_id").agg(F.min_by("token", F.struct("df", "token")).alias("token"))
    found = (
        posting.join(rarest, "token").join(asked, "item_id").join(table(spark, d, "documents").select("doc_id", "text"), "doc_id")
        .where(F.contains("text", F.col("item"))).select("item_id", "doc_id")
    )
    held = found.groupBy("item_id").agg(F.count("*").alias("h"), F.min("doc_id").alias("first_holder"))
    return asked.select("item_id").join(held, "item_id", "left").select("item_id", F.coalesce("h", F.lit(0)).cast("long").alias("holders"), "first_holder")


@query(f"""WITH {ROUTES}, p AS (SELECT query_id, count(*) FILTER (route = 'content') AS lexical_rows, count(*) FILTER (route = 'fields') AS field_rows, count(DISTINCT doc_id) AS documents FROM routes GROUP BY 1)
SELECT query_id, lexical_rows, field_rows, documents, CASE WHEN lexical_rows = 0 THEN 'degraded' WHEN documents < lexical_rows + field_rows THEN 'agreed' ELSE 'split' END AS status FROM p""")
def shadow_records(spark: SparkSession, d: str) -> DataFrame:
    """One telemetry row a query: what each route gave and how far they agree."""
    p = routes(spark, d).groupBy("query_id").agg(
        F.count_if(F.col("route") == "content").alias("lexical_rows"), F.count_if(F.col("route") == "fields").alias("field_rows"), F.countDistinct("doc_id").alias("documents")
    )
    status = F.when(F.col("lexical_rows") == 0, "degraded").when(F.col("documents") < F.col("lexical_rows") + F.col("field_rows"), "agreed").otherwise("split")
    return p.withColumn("status", status)


@query(f"""WITH c AS (SELECT item_id, unnest({TOKENS_SQL.format(c="text")}) AS token FROM benchmark), f AS (SELECT doc_id, unnest({TOKENS_SQL.format(c="text")}) AS token FROM documents),
n AS (SELECT item_id, count(*) AS n FROM c GROUP BY 1), s AS (SELECT item_id, doc_id, count(*) AS hits FROM c JOIN f USING (token) WHERE length(token) >= 5 GROUP BY ALL)
SELECT item_id, arg_max(doc_id, (hits, -doc_id)) AS best_doc, round(max(hits) / any_value(n), 4) AS support FROM s JOIN n USING (item_id) GROUP BY item_id""")
def claims_audit(spark: SparkSession, d: str) -> DataFrame:
    """The document that holds most of a claim's longer tokens."""
    tokens = lexical.query_tokens(items(spark, d))
    hits = content(spark, d).where("length(token) >= 5").join(tokens, "token").groupBy("query_id", "doc_id", "n_tokens").agg(F.count("*").alias("hits"))
    best = hits.groupBy(F.col("query_id").alias("item_id")).agg(F.max(F.struct("hits", (-F.col("doc_id")).alias("low"), "n_tokens")).alias("m"))
    return best.select("item_id", (-F.col("m.low")).alias("best_doc"), F.round(F.col("m.hits") / F.col("m.n_tokens"), 4).alias("support"))
