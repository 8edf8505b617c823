import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def sf():
    return "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def documents(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet").cache()


@pytest.fixture(scope="session")
def edge_docs(spark):
    """Nulls in every column, empty and blank texts, a very long text and line, repeated rows,
    ties, and extra columns with the names of results."""
    body = "the quick brown fox jumps over the lazy dog and runs away from the old grey wolf " * 6
    rows = [
        (1, body, "en", "a", 1), (1, body, "en", "a", 1), (2, body + "once more now", "en", "a", 1), (3, "", "en", "b", 0), (4, None, None, None, None),
        (None, body, "en", "a", 1), (None, None, None, None, None), (5, " \t\n\r\x0b\x0c ", "de", "b", 7), (6, "one two", "de", "b", 7), (7, "One TWO", "de", "b", 7),
        (8, " ".join(f"w{i}" for i in range(60_000)), "en", "c", 5), (9, "x" * 300_000, "en", "c", 5), (10, "É é ß \ue000 𝔘 日本 語。", "fr", None, 9),
    ]
    frame = spark.createDataFrame(rows, DOCS)
    extra = {c: "clash" for c in ("component_id", "kept", "n_words", "shard", "slot", "size", "key", "id", "words", "items", "mix_key", "part", "n", "hits")}
    from pyspark.sql import functions as F

    return frame.withColumns({k: F.lit(v) for k, v in extra.items()})


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], DOCS)
