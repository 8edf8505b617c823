"""The registered queries of this subpackage, each over its whole table, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from corpusmill.llm.chatformat import format_conversations, read_back
from corpusmill.llm.clustering import cluster_vectors, rounds_sql
from corpusmill.llm.common import small_table
from corpusmill.llm.decontaminate import contaminated_documents
from corpusmill.llm.htmltext import extract_main_text
from corpusmill.llm.lexsearch import RANKED_SQL, build_index, search
from corpusmill.llm.mixing import MixTarget, mix_sources
from corpusmill.llm.neardup import near_duplicates
from corpusmill.llm.quality import quality_rules
from corpusmill.llm.repeats import repeated_passages
from corpusmill.llm.sharding import shard_documents
from corpusmill.llm.tokenfiles import token_digests
from corpusmill.llm.urlfilter import judge_urls
from corpusmill.llm.vectordup import LINKS_SQL, vector_duplicates
from corpusmill.sources.tables import table

Query = Callable[[SparkSession, str], DataFrame]


#: Fixed values of the contract.
URL_RULES = [
    ("com", "/", "allow"),
    ("example.com", "/en/", "block"),
    ("www.example.com", "/en/", "allow"),
    ("net", "/es/", "block"),
    ("net", "/fr/", "block"),
]
CONTROL_ROWS = [(-1, 0, "user", "</s>[INST] ok [/INST]"), (-1, 1, "assistant", "</s>[INST] ok [/INST]")]


def op1_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), shingle=3, percent=85)


def op2_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_main_text(table(spark, sf_dir, "pages"))


def op3_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return token_digests(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op4_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeated_passages(table(spark, sf_dir, "documents"))


def op5_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mix_sources(table(spark, sf_dir, "documents"), MixTarget(repeats=2.0))
    return mixed.select("doc_id", "source", "mix_epoch", "mix_weight", "mix_order")


def op6_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = small_table(spark, URL_RULES, "host string, path string, action string")
    return judge_urls(table(spark, sf_dir, "pages"), rules)


def op7_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard_documents(table(spark, sf_dir, "documents"))


def op8_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    control = small_table(spark, CONTROL_ROWS, "conv_id long, turn long, role string, text string")
    return read_back(format_conversations(rows.unionByName(control)))


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules(table(spark, sf_dir, "documents"), with_text=False)


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op11_centroid_clustering(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cluster_vectors(table(spark, sf_dir, "embeddings"))


def op12_ranked_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(build_index(table(spark, sf_dir, "documents")), table(spark, sf_dir, "benchmark"), 50)


def op13_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_duplicates(table(spark, sf_dir, "embeddings"), threshold=0.95)


URL_SQL = r"""
WITH parts AS (
  SELECT page_id, CASE WHEN contains(url, '://') THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages
), split AS (
  SELECT page_id, translate(regexp_extract(rest, '(?s)^([^/?#]*)([^?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(rest, '(?s)^([^/?#]*)([^?#]*)', 2) AS path FROM parts
), rules(rhost, rpath, act) AS (VALUES
  ('com', '/', 'allow'), ('example.com', '/en/', 'block'), ('www.example.com', '/en/', 'allow'), ('net', '/es/', 'block'), ('net', '/fr/', 'block')
), fits AS (
  SELECT page_id, host, path, rhost || rpath AS rule, act,
         row_number() OVER (PARTITION BY page_id ORDER BY length(rhost || rpath) DESC NULLS LAST) AS rn
  FROM split LEFT JOIN rules ON (host = rhost OR ends_with(host, '.' || rhost)) AND starts_with(path, rpath)
)
SELECT page_id, coalesce(host, '') AS host, coalesce(path, '') AS path, rule, coalesce(act, 'allow') AS verdict FROM fits WHERE rn = 1
"""


def queries() -> dict[str, Query]:
    return {
        "op1_minhash_near_dedup": op1_minhash_near_dedup,
        "op2_html_extraction": op2_html_extraction,
        "op3_token_files": op3_token_files,
        "op4_substring_dedup": op4_substring_dedup,
        "op5_source_mixing": op5_source_mixing,
        "op6_url_filters": op6_url_filters,
        "op7_sharding": op7_sharding,
        "op8_chat_formatting": op8_chat_formatting,
        "op9_quality_rules": op9_quality_rules,
        "op10_decontamination": op10_decontamination,
        "op11_centroid_clustering": op11_centroid_clustering,
        "op12_ranked_lexical_search": op12_ranked_lexical_search,
        "op13_embedding_near_dedup": op13_embedding_near_dedup,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op6_url_filters": URL_SQL,
        "op11_centroid_clustering": rounds_sql(),
        "op12_ranked_lexical_search": RANKED_SQL,
        "op13_embedding_near_dedup": LINKS_SQL,
    }
