"""Chunking and order-dependent selections over the tables; without SQL, tested in ``tests``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusmill.operators import chunking as C
from corpusmill.operators import selection as S
from corpusmill.plans.registry import query
from corpusmill.plans.retrieval import items, routes
from corpusmill.sources.tables import table


def notes(spark: SparkSession, d: str) -> DataFrame:
    """Documents as Markdown notes: the first line a heading, each other line a paragraph."""
    lines = F.split("text", "\n", -1)
    body = F.array_join(F.slice(lines, 2, F.size(lines)), "\n\n")
    text = F.concat(F.lit("# "), F.element_at(lines, 1), F.lit("\n\n"), body)
    return table(spark, d, "documents").select(F.concat_ws("/", "source", F.concat("doc_id", F.lit(".md"))).alias("path"), text.alias("text"))


@query()
def chunk_paragraphs(spark: SparkSession, d: str) -> DataFrame:
    return C.paragraph_chunks(notes(spark, d))


@query()
def chunk_structure(spark: SparkSession, d: str) -> DataFrame:
    return C.structure_chunks(notes(spark, d))


@query()
def chunk_structure_merged(spark: SparkSession, d: str) -> DataFrame:
    return C.merged_chunks(C.structure_chunks(notes(spark, d)))


@query()
def chunk_report(spark: SparkSession, d: str) -> DataFrame:
    every = notes(spark, d)
    return C.validation(every, C.structure_chunks(every))


@query()
def chunk_coverage(spark: SparkSession, d: str) -> DataFrame:
    """How much of each note its merged chunks hold, by their places."""
    every = notes(spark, d)
    return C.coverage(every, C.merged_chunks(C.structure_chunks(every)))


@query()
def chunk_bucket_entries(spark: SparkSession, d: str) -> DataFrame:
    """Each source's documents as the entries of one bucket note a hundred documents, and their chunks."""
    docs = table(spark, d, "documents")
    entry = F.concat(F.lit("## mem-"), F.lpad(F.lower(F.hex("doc_id")), 8, "0"), F.lit("\n> importance=3 | tags="), "lang", F.lit("\n\n"), "text", F.lit("\n"))
    gathered = docs.groupBy("source", F.floor(F.col("doc_id") / 100).alias("part")).agg(F.array_sort(F.collect_list(F.struct("doc_id", entry.alias("entry")))).alias("all"))
    text = F.concat(F.lit("---\nbucket: true\n---\n# "), "source", F.lit("\n"), F.array_join(F.transform("all", lambda x: x["entry"]), "\n"))
    return C.bucket_chunks(gathered.select(F.concat_ws("/", "source", "part").alias("path"), text.alias("text")))


@query()
def chunk_boundary(spark: SparkSession, d: str) -> DataFrame:
    """The share of chunks that end with a sentence."""
    ends = F.rtrim("content").rlike(r"[.。！？…；!?]$")
    return C.structure_chunks(notes(spark, d)).groupBy("kind").agg(F.count("*").alias("n"), F.round(F.avg(ends.cast("int")), 4).alias("coherent"))


@query()
def context_packing(spark: SparkSession, d: str) -> DataFrame:
    rows = routes(spark, d).where("route = 'fields'").join(table(spark, d, "documents").select("doc_id", "lang", "n_chars"), "doc_id")
    rows = rows.select(
        F.col("query_id").alias("request"), F.col("doc_id").alias("id"), (F.col("rank") == 1).alias("required"), (F.col("doc_id") % 3).alias("priority"),
        (1.0 / F.col("rank")).alias("score"), F.col("lang").alias("zone"), F.ceil(F.col("n_chars") / 4).alias("tokens"),
    )
    return S.packed_context(rows, 4000, 2500)


@query()
def required_group_coverage(spark: SparkSession, d: str) -> DataFrame:
    rows = routes(spark, d).where("route = 'content'").select("query_id", F.col("doc_id").alias("ref"), "rank")
    groups = rows.where("rank > 20").select("query_id", (F.col("ref") % 3).alias("group_no"), "ref")
    return S.covered_groups(rows.where("rank <= 40"), groups, 8)


@query()
def word_diff(spark: SparkSession, d: str) -> DataFrame:
    pair = table(spark, d, "benchmark").select(F.col("item_id").alias("id"), F.col("text").alias("old"), F.regexp_replace("text", r"\bthe\b|\bde\b", "a").alias("new"))
    return S.word_changes(pair)


@query()
def citation_tokens(spark: SparkSession, d: str) -> DataFrame:
    turns = table(spark, d, "conversations").where("role = 'assistant'")
    answer = F.concat("text", F.lit(" [1] see [[note-"), "turn", F.lit("]] `[9]` [1]"))
    return S.citations(turns.select((F.col("conv_id") * 1000 + F.col("turn")).alias("id"), answer.alias("answer")))
