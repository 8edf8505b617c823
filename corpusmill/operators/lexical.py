"""Inverted-index retrieval: postings, document frequency, ranked candidates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusmill.functions.text import index_tokens, ranking_tokens
from corpusmill.operators.ranking import best_documents, ranked_terms, term_frequency
from corpusmill.session import stored

#: Field weights of the index.
FIELD_WEIGHTS = {"content": 1.0, "title": 3.0, "tags": 2.0, "path": 2.0}


def notes(documents: DataFrame) -> DataFrame:
    """Documents as notes: the first line is the title, the language a tag, the source the folder."""
    return documents.select(
        "doc_id",
        F.concat_ws("/", "source", F.concat("doc_id", F.lit(".md"))).alias("path"),
        F.substring_index("text", "\n", 1).alias("title"),
        F.col("lang").alias("tags"),
        F.col("text").alias("content"),
        "lang",
        "source",
    )


def postings(docs: DataFrame, fields: dict[str, float] = FIELD_WEIGHTS) -> DataFrame:
    """(token, doc_id, weight, fields): the summed weights of the fields that hold a token.

    Each field is tokenized in its row; the one shuffle is by (token, document)."""
    per_field = F.array(
        *[F.struct(F.lit(f).alias("field"), F.lit(w).alias("weight"), index_tokens(F.col(f)).alias("tokens")) for f, w in fields.items()]
    )
    return (
        docs.select("doc_id", F.inline(per_field))
        .select("doc_id", "field", "weight", F.explode("tokens").alias("token"))
        .groupBy("token", "doc_id")
        .agg(F.sum("weight").alias("weight"), F.array_join(F.array_sort(F.collect_list("field")), "|").alias("fields"))
    )


def content_postings(docs: DataFrame) -> DataFrame:
    """(token, doc_id) of the text alone; a token set needs no grouping."""
    return docs.select("doc_id", F.explode(index_tokens(F.col("text"))).alias("token"))


def document_frequency(posting: DataFrame) -> DataFrame:
    return posting.groupBy("token").agg(F.count("*").alias("df"))


def idf(df: Column, n: Column) -> Column:
    return F.log((n + 1) / (df + 1)) + 1


def query_tokens(queries: DataFrame) -> DataFrame:
    """(query_id, token, n_tokens) of queries (query_id, text)."""
    return queries.select("query_id", ranking_tokens(index_tokens(F.col("text"))).alias("tokens")).select(
        "query_id", F.size("tokens").alias("n_tokens"), F.explode("tokens").alias("token")
    )


def top_k(rows: DataFrame, k: int, by: list[str], *order) -> DataFrame:
    """The first ``k`` rows of each group with their ``rank``; Spark limits groups before the shuffle."""
    window = Window.partitionBy(*by).orderBy(*order)
    return rows.withColumn("rank", F.row_number().over(window)).where(F.col("rank") <= k)


def lexical_topk(posting: DataFrame, tokens: DataFrame, k: int, column: str = "weights") -> DataFrame:
    """(query_id, doc_id, score, matched, rank) over a posting (token, doc_id, weight) or over ``document_terms`` with the weights ``column``."""
    return best_documents(posting, tokens, k, column)


def weighed_terms(terms: DataFrame, tokens: DataFrame, n_docs: DataFrame) -> DataFrame:
    """``tokens`` (query_id, token) with ``term`` and ``idf`` over the whole index."""
    held = tokens.withColumn("term", F.xxhash64("token")).join(term_frequency(terms), "term", "left")
    return held.join(F.broadcast(n_docs)).withColumn("idf", idf(F.coalesce("df", F.lit(0)), F.col("n"))).drop("n", "df")


def lexical_idf_topk(terms: DataFrame, tokens: DataFrame, n_docs: DataFrame, k: int) -> DataFrame:
    """Ranked by the matched tokens' idf over the whole index; ties by document. ``terms``: doc_id, terms, content."""
    asked = weighed_terms(terms, tokens, n_docs).select("query_id", "term", F.col("idf").alias("weight"))
    return ranked_terms(terms, asked, k, decimals=6, column="content")


#: From which idf on an identifier is rare; how many candidates a ranking looks at.
RARE_IDF, CANDIDATES = 2.5, 50


def rescued_topk(terms: DataFrame, titles: DataFrame, tokens: DataFrame, n_docs: DataFrame, k: int) -> DataFrame:
    """(query_id, doc_id, score, rescued, rank). Candidates are those with the highest scores, and those with
    a rare identifier of the question in their title, which then count by their rare identifiers alone. Where a
    question has one rare identifier and a candidate has it in its title, the order is: title, score, coverage by idf, matched
    idf, all identifiers, reference, all descending; elsewhere score, then the lowest document.

    ``terms``: doc_id, terms, weights; ``titles``: doc_id and the terms of its title; ``tokens``: query_id, token. A question's tokens
    are looked up in its candidates alone."""
    ident = (F.length("token") >= 3) & (F.octet_length("token") == F.length("token"))
    weighed = stored(weighed_terms(terms, tokens, n_docs).select("query_id", "term", "idf", ident.alias("ident")), "weighed-terms")
    base = best_documents(terms, tokens, CANDIDATES).select("query_id", "doc_id", "score")
    rare = weighed.where(F.col("ident") & (F.col("idf") >= RARE_IDF))
    second = ranked_terms(terms, rare.select("query_id", "term", F.lit(1.0).alias("weight")), CANDIDATES).select("query_id", "doc_id", F.col("score").alias("rare_score"))
    names = rare.groupBy("query_id").agg(F.collect_list("term").alias("rare"))
    titled = second.join(names, "query_id").join(titles, "doc_id").where(F.arrays_overlap("title", "rare")).select("query_id", "doc_id", "rare_score").distinct()
    both = stored(base.join(titled, ["query_id", "doc_id"], "full_outer"), "rescue-candidates")
    every = weighed.groupBy("query_id").agg(F.collect_list(F.struct("term", "idf", "ident")).alias("asked"))
    hits = F.filter("asked", lambda a: F.array_contains("terms", a["term"]))
    held = both.select("query_id", "doc_id").join(every, "query_id").join(terms.select("doc_id", "terms"), "doc_id").select("query_id", "doc_id", hits.alias("hits"))
    own = held.select(
        "query_id", "doc_id", F.aggregate("hits", F.lit(0.0), lambda s, h: s + h["idf"]).alias("matched"), F.size(F.filter("hits", lambda h: h["ident"])).alias("hit")
    )
    asked = weighed.groupBy("query_id").agg(F.sum("idf").alias("total"), F.count_if("ident").alias("ids"), F.count_if(F.col("ident") & (F.col("idf") >= RARE_IDF)).alias("rares"))
    titled = F.col("rare_score").isNotNull()
    rows = both.join(own, ["query_id", "doc_id"]).join(asked, "query_id").select(
        "query_id", "doc_id", F.coalesce("rare_score", "score").alias("score"), (titled & (F.col("ids") == 1)).cast("int").alias("in_title"),
        F.round(F.col("matched") / F.col("total"), 9).alias("coverage"), F.round("matched", 9).alias("matched"), ((F.col("ids") > 0) & (F.col("hit") == F.col("ids"))).cast("int").alias("every"),
        (F.bool_or(titled).over(Window.partitionBy("query_id")) & (F.col("rares") == 1)).alias("rescued"),
    )
    then = lambda c, other=0: F.desc(F.when(F.col("rescued"), c).otherwise(other))
    order = [then(F.col("in_title")), F.desc("score"), then(F.col("coverage")), then(F.col("matched")), then(F.col("every")), then(F.col("doc_id"), -F.col("doc_id"))]
    return top_k(rows, k, ["query_id"], *order).select("query_id", "doc_id", "score", "rescued", "rank")
