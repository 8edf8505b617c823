"""Streams cut from a table: each row is written once from its own stretch, in files that several tasks write; states of many keys in few calls."""

from datetime import datetime, timedelta

from pyspark.sql import functions as F

from corpusmill.streaming import streams as S

START = datetime(2024, 1, 1)


def batches(stream):
    seen = []
    run = stream.writeStream.foreachBatch(lambda b, n: seen.append((b.rdd.getNumPartitions(), *b.agg(F.min("ts"), F.max("ts"), F.count("*")).first()))).trigger(availableNow=True).start()
    run.awaitTermination()
    return seen


def test_many_rows_are_few_batches_of_several_files(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(S, "SLICE_ROWS", 4000)
    monkeypatch.setattr(S, "READERS", 4)
    rows = spark.range(40_000).selectExpr("id as event_id", "timestamp'2024-01-01' + make_interval(0, 0, 0, 0, 0, 0, id * if(id < 39990, 1, 100)) as ts")
    rows.write.parquet(f"{tmp_path}/events.parquet")
    seen = batches(S.in_slices(spark, f"{tmp_path}/events.parquet"))
    assert sum(s[3] for s in seen) == 40_000 and all(a[2] < b[1] for a, b in zip(seen, seen[1:], strict=False))
    assert len(seen) <= S.SLICES and max(s[3] for s in seen) > 4000  # a file a batch made ten batches


def test_small_stretches_go_together():
    assert S.stretches([5, 0, 0, 5, 1], 4) == [(0, 0), (1, 4)]
    assert S.stretches([0, 0, 9], 4) == [(0, 2)] and S.stretches([1, 0, 2], 0) == [(0, 0), (1, 1), (2, 2)]
    assert S.stretches([9, 9, 1], 4) == [(0, 0), (1, 2)]


def test_keys_share_calls_and_leases_end_for_each(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(S, "GROUPS", 2)
    at = lambda s: START + timedelta(seconds=s)
    one = [(u, 10 * u + i, at(i), kind) for u in range(20) for i, kind in enumerate(("signup", "view"))]
    later = [[(99, 1000, at(5000), "signup")], [(99, 1001, at(6000), "click"), (3, 1002, at(6000), "purchase"), (None, 1003, at(6000), "signup")], [(99, 1004, at(9000), "view")]]
    for rows in [one, *later]:
        spark.createDataFrame(rows, "user_id long, event_id long, ts timestamp, event_type string").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    out = S.drained(S.task_states(S.timed(S.parquet_stream(spark, f"{tmp_path}/in"), "60 seconds")), "shared", "update").collect()
    last = {}
    for r in sorted(out, key=lambda r: r.moves + r.ignored):
        last.setdefault(r.user_id, []).append((r.status, r.moves, r.ignored))
    assert len(last) == 22 and last[99][-1] == ("running", 2, 1) and last[None][-1] == ("pending", 1, 0)
    assert all(set(last[u]) == {("running", 2, 0), ("pending", 2, 0)} for u in range(20) if u != 3)
    assert ("running", 2, 0) in last[3] and last[3][-1][1:] in {(2, 1), (3, 0)}


def test_tasks_of_a_queue_share_calls(spark, tmp_path, monkeypatch):
    """Two groups hold 40 tasks: their states are loaded twice a batch, each lease that ends is told once."""
    from corpusmill.streaming import cycles

    monkeypatch.setattr(cycles, "GROUPS", 2)
    at = lambda s: START + timedelta(seconds=s)
    rows = [(u, 10 * u + i, at(u + i), op) for u in range(40) for i, op in enumerate(("enqueue", "claim"))]
    for part in (rows, [(99, 1000, at(5000), "enqueue")], [(99, 1001, at(6000), "claim")]):
        spark.createDataFrame(part, "task_id long, event_id long, ts timestamp, op string").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    stream = S.parquet_stream(spark, f"{tmp_path}/in").withColumnRenamed("ts", "at").withWatermark("at", "60 seconds")
    grouped = cycles.queue(stream)
    assert "at_once" in grouped._jdf.queryExecution().logical().toString()
    with cycles.rocks_state(spark):
        got = S.drained(grouped, "shared_queue", "update").collect()
    assert sorted(r.task_id for r in got if r.outcome == "recovered") == list(range(40)) and sum(r.outcome == "claimed" for r in got) == 41
