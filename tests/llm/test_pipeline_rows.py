"""No stage of the pipeline loses or keeps a row for another one's sake."""

import corpus_pipeline
from tests.llm.brute import by_key

TEXT = "The mill at the river has stood there since the great flood, and its wheel still turns in spring. " * 6


def rows_of(spark, rows):
    return spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")


def test_one_of_repeated_rows_stays(spark, sf):
    other = "Quite another text about boats and nets and the weather of the northern sea in autumn days. "
    docs = rows_of(spark, [(1, TEXT)] * 3 + [(None, TEXT)] * 2 + [(1, other), (None, other + "and a tail of ten words that no other text has"), (None, None or "")] + [(None, "")])
    out = corpus_pipeline.near_dedup(spark, docs, sf).collect()
    assert by_key((r.doc_id, r.text) for r in out) == by_key([(1, TEXT), (1, other), (None, other + "and a tail of ten words that no other text has"), (None, ""), (None, "")])


def test_rows_of_null_ids_only_leave_one(spark, sf):
    docs = rows_of(spark, [(None, TEXT)] * 2 + [(None, TEXT + "once more")])
    assert corpus_pipeline.near_dedup(spark, docs, sf).count() == 1


def test_a_clean_row_outlives_its_contaminated_namesake(spark, sf):
    item = spark.read.parquet(f"{sf}/benchmark.parquet").first()["text"]
    docs = rows_of(spark, [(1, item), (1, TEXT), (None, item), (None, TEXT), (None, TEXT)])
    out = corpus_pipeline.decontaminate(spark, docs, sf).collect()
    assert by_key((r.doc_id, r.text) for r in out) == by_key([(1, TEXT), (None, TEXT), (None, TEXT)])
