"""Results that no single row and no memory table may hold."""

from corpusmill import catalogue
from corpusmill.streaming import streams as S


def test_streams_end_in_files(spark, tmp_path):
    for i in range(3):
        spark.range(i * 10, i * 10 + 10).selectExpr("id % 4 AS k").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    before = {t.name for t in spark.catalog.listTables()}
    stream = S.parquet_stream(spark, f"{tmp_path}/in")
    rows = S.drained(stream, "rows", "append")
    counts = S.drained(stream.groupBy("k").count(), "counts", "complete")
    updates = S.drained(stream.groupBy("k").count(), "updates", "update")
    assert rows.inputFiles() and counts.inputFiles() and {t.name for t in spark.catalog.listTables()} == before
    assert rows.count() == 30 and sorted(map(tuple, counts.collect())) == [(0, 8), (1, 8), (2, 7), (3, 7)]
    assert updates.count() == 12 and updates.groupBy("k").max("count").count() == 4


def test_no_row_holds_a_source(spark):
    plan = catalogue.queries()["manifest_hash"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().toString()
    assert "collect_list" not in plan
