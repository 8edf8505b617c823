"""The corpus pipeline: five stages over ``documents``, each written as Parquet and reread.

Stages 1 to 4 return the columns of ``documents``; the last adds ``shard`` and ``slot``.
No SQL states the whole (near-duplicates and k-d splits are not relational), so the
stages are tested against brute force in ``tests/llm``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from corpusmill.llm.common import scratch_path
from corpusmill.llm.decontaminate import without_contaminated
from corpusmill.llm.mixing import MixTarget, mix_sources
from corpusmill.llm.neardup import deduplicated
from corpusmill.llm.quality import clean_documents
from corpusmill.llm.sharding import place_rows
from corpusmill.sources.tables import table

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
ORACLE_SQL = None


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejected documents go; of the others, lines that break a rule."""
    return clean_documents(docs.select(COLUMNS))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of near copies stays: that with the smallest id."""
    return deduplicated(docs.select(COLUMNS))


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a window of a benchmark item go."""
    return without_contaminated(docs.select(COLUMNS), table(spark, sf_dir, "benchmark"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources at the temperature at which none repeats more than twice; every document
    is used at least once, those of small sources again."""
    return mix_sources(docs, MixTarget(repeats=2.0)).select(COLUMNS)


def shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """24 shards of near equal bytes, with a gapless slot in each."""
    return place_rows(docs.select(COLUMNS), 24, "bytes")


STAGES = [
    ("quality rules", quality),
    ("near-duplicates", near_dedup),
    ("decontamination", decontaminate),
    ("mixing", mix),
    ("sharding", shard),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = scratch_path(spark, name.replace(" ", "-"))
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
