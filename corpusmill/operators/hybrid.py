"""Lexical and vector routes over one corpus: which rows each gives, why one gives none, and their fusion."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusmill.operators.lexical import idf, top_k
from corpusmill.operators.ranking import best_documents, by_document, ranked_terms, term_frequency
from corpusmill.operators.vectors import cosine_topk
from corpusmill.session import stored

#: A question that is one opaque name, that asks for something absent, that asks for a topic or an entry, that asks for meaning.
#: The first is matched whole, with at least ``NAME_LENGTH`` characters and no white space.
OPAQUE_NAME = r"(?i)(?:bv[a-z0-9]*\d[a-z0-9]*|[a-z]{2,}[a-z0-9]*\d[a-z0-9]*)"
NAME_LENGTH = 8
ABSENT = r"(?:没有|无|不存在|找不到|是否有|有没有|未找到|不包含|without|not found)"
TOPIC = (
    r"(?:主题|覆盖|知识库|记忆|条目|记录|规定|目录|存放|路径|局限|经验|状态|检查|核对|先|之前|以前|什么|哪些|哪里|怎么|如何|为何|为什么|"
    r"哪种|分别|适用|算哪|解决|处理|失败|不完整|孤岛|补出链)"
)
MEANING = r"(?:什么|哪些|哪里|怎么|如何|为何|为什么|哪种|分别|适用|覆盖|存放|执行后|前要|规模|主题|经验|路径|区别|规定|算哪|解决)"
#: Candidates of a route, parent entries for each of them and at most, rows that coverage looks at, the constant of the fusion.
CANDIDATES, PARENTS, MOST_PARENTS, COVERED_ROWS, RRF_K = 40, 3, 120, 3, 60


def opaque_name(text: Column) -> Column:
    t = F.trim(F.coalesce(text, F.lit("")))
    return ~t.rlike(r"\s") & (F.length(t) >= NAME_LENGTH) & t.rlike("^" + OPAQUE_NAME + "$")


def asks(text: Column, pattern: str) -> Column:
    """Whether a question is of the kind ``pattern`` and neither empty, an opaque name nor about something absent."""
    t = F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), r"\s+", " "))
    return (t != "") & ~opaque_name(t) & ~t.rlike("(?i)" + ABSENT) & t.rlike("(?i)" + pattern)


@dataclass(frozen=True)
class Gates:
    """Share of a question's tokens that the first lexical rows have to hold, and the least cosine of a vector row."""

    coverage: float = 0.0
    cosine: float = 0.0


def coverage(first: DataFrame, terms: DataFrame, tokens: DataFrame) -> DataFrame:
    """(query_id, coverage): the share of tokens that the rows ``first`` (query_id, doc_id) hold; 0 where a
    token of three or more characters is in none of them. ``terms``: doc_id, terms."""
    long = F.length("token") >= 3
    wanted = tokens.groupBy("query_id").agg(F.collect_set(F.struct(F.xxhash64("token").alias("term"), long.alias("long"))).alias("wanted"))
    held = F.filter("wanted", lambda w: F.array_contains("terms", w["term"]))
    found = first.join(wanted, "query_id").join(terms.select("doc_id", "terms"), "doc_id").select("query_id", F.inline(held)).distinct()
    found = found.groupBy("query_id").agg(F.count("*").alias("held"), F.count_if("long").alias("held_long"))
    asked = tokens.groupBy("query_id").agg(F.count("*").alias("n"), F.count_if(long).alias("n_long"))
    share = F.round(F.coalesce("held", F.lit(0)) / F.col("n"), 6)
    return asked.join(found, "query_id", "left").select("query_id", F.when(F.coalesce("held_long", F.lit(0)) < F.col("n_long"), 0.0).otherwise(share).alias("coverage"))


def parents(terms: DataFrame, tokens: DataFrame, n_docs: DataFrame, k: int) -> DataFrame:
    """(query_id, doc_id, rank): entries by the summed weight times idf of the tokens that they hold, the idf among the
    entries that hold one; here an entry is a document."""
    own = tokens.groupBy("query_id", F.xxhash64("token").alias("term")).agg(F.count("*").alias("times"))
    weighed = own.join(term_frequency(terms), "term").join(F.broadcast(n_docs)).withColumn("weight", idf(F.col("df") * F.col("times"), F.col("n")))
    asked = weighed.select("query_id", "term", F.explode(F.array_repeat("weight", F.col("times").cast("int"))).alias("weight"))
    return ranked_terms(terms, asked, k, decimals=4, counted=True).select("query_id", "doc_id", "rank")


def collect_routes(questions: DataFrame, posting: DataFrame, tokens: DataFrame, n_docs: DataFrame, vectors: DataFrame, gates: Gates = Gates(), k: int = CANDIDATES) -> tuple[DataFrame, DataFrame]:
    """(routes, statuses): (query_id, route, doc_id, rank) of the routes ``lexical`` and ``vector``, and (query_id, route,
    reason, rows) for every question of ``questions`` (query_id, text, unit).

    Questions about a topic have the best entries before their lexical rows. Lexical rows that cover too little of the
    question are dropped. A question that is an opaque name and finds nothing by words gets no vector rows, nor does one without a vector.
    Repeats of a document within a route keep their first place. ``posting``: token, doc_id, weight, or ``ranking.document_terms``."""
    terms = posting if "terms" in posting.columns else stored(by_document(posting), "posting-terms")
    kinds = questions.select("query_id", opaque_name(F.col("text")).alias("opaque"), asks(F.col("text"), TOPIC).alias("topic"), F.col("unit").isNotNull().alias("vectored"))
    own = best_documents(terms, tokens, k).select("query_id", "doc_id", F.lit(1).alias("part"), "rank")
    topics = kinds.where("topic").select("query_id")
    most = max(1, min(MOST_PARENTS, PARENTS * k))
    above = parents(terms, tokens.join(topics, "query_id", "left_semi"), n_docs, most).select("query_id", "doc_id", F.lit(0).alias("part"), "rank")
    first = own.unionByName(above).groupBy("query_id", "doc_id").agg(F.min(F.struct("part", "rank")).alias("place"))
    placed = stored(top_k(first, most + k, ["query_id"], "place").select("query_id", "doc_id", "rank"), "lexical-route")
    covered = coverage(placed.where(F.col("rank") <= COVERED_ROWS), terms, tokens)
    judged = kinds.join(covered, "query_id", "left").join(placed.groupBy("query_id").agg(F.count("*").alias("found")), "query_id", "left")
    judged = judged.withColumn("found", F.coalesce("found", F.lit(0))).withColumn("thin", (F.col("found") > 0) & (F.coalesce("coverage", F.lit(0.0)) < gates.coverage))
    judged = stored(judged.withColumn("skip", F.col("opaque") & ((F.col("found") == 0) | F.col("thin"))), "routes-judged")
    asked = questions.join(judged.where("vectored AND NOT skip").select("query_id"), "query_id", "left_semi").select("query_id", "unit")
    near = cosine_topk(asked, vectors, k).where(F.col("score") >= gates.cosine).select("query_id", F.lit("vector").alias("route"), F.col("vec_id").alias("doc_id"), "rank")
    lexical = placed.join(judged.where("thin").select("query_id"), "query_id", "left_anti").select("query_id", F.lit("lexical").alias("route"), "doc_id", "rank")
    routes = stored(lexical.unionByName(near), "hybrid-routes")
    rows = routes.groupBy("query_id", "route").agg(F.count("*").alias("rows"))
    reasons = F.array(
        F.struct(F.lit("lexical").alias("route"), F.when(F.col("thin"), "coverage_below").otherwise("").alias("reason")),
        F.struct(F.lit("vector").alias("route"), F.when(F.col("skip"), "identifier_lexical_miss_skip").when(~F.col("vectored"), "question_without_vector").otherwise("").alias("reason")),
    )
    statuses = judged.select("query_id", F.inline(reasons)).join(rows, ["query_id", "route"], "left").select("query_id", "route", "reason", F.coalesce("rows", F.lit(0)).alias("rows"))
    return routes, statuses


def displayed(routes: DataFrame, questions: DataFrame, mode: str, fallback: str, k: int) -> DataFrame:
    """(query_id, display, doc_id, score, rank): ``off`` and ``shadow`` show the lexical rows, ``on`` both routes fused; with
    ``fallback`` on, ``shadow`` shows both for questions about meaning. Ties go by document."""
    guarded = asks(F.col("text"), MEANING) if mode == "shadow" and fallback == "on" else F.lit(False)
    display = F.when(F.lit(mode == "on"), "hybrid").when(guarded, "guarded_hybrid_fallback").otherwise("lexical")
    shown = questions.select("query_id", display.alias("display")).join(routes, "query_id").where("display <> 'lexical' OR route = 'lexical'")
    fused = shown.groupBy("query_id", "display", "doc_id").agg(F.round(F.sum(1.0 / (RRF_K + F.col("rank"))), 6).alias("score"))
    return top_k(fused, k, ["query_id"], F.desc("score"), "doc_id").select("query_id", "display", "doc_id", "score", "rank")

