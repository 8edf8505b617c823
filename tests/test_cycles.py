"""Keyed cycles over several batches against plain loops; late rows; scans and repairs that are tried again."""

import random
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from corpusmill.streaming import cycles, scans
from corpusmill.streaming import streams as S

START = datetime(2024, 1, 1)


def in_files(spark, folder, batches, schema):
    """One file a batch, in the order in which they are to be read."""
    for rows in batches:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(folder)
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(folder)


def cut(rows, parts):
    size = -(-len(rows) // parts)
    return [rows[i : i + size] for i in range(0, len(rows), size)]


def test_queue_equals_a_loop(spark, tmp_path):
    rng = random.Random(3)
    ops = ["enqueue", "claim", "claim", "claim", "claim", "fail", "fail", "fail", "fail", "succeed", "cancel"] + ["claim", "fail"] * 6
    rows = [(rng.randrange(6), i, START + timedelta(seconds=20 * i + rng.randrange(15)), rng.choice(ops)) for i in range(400)]
    rows = [(99, 1000, START, "enqueue"), (99, 1001, START + timedelta(seconds=1), "claim"), (98, 1002, START, "enqueue"), (98, 1003, START, "claim"), (98, 1004, START + timedelta(seconds=2), "fail"), *rows]
    stream = in_files(spark, f"{tmp_path}/in", cut(rows, 4), "task_id long, event_id long, ts timestamp, op string")
    events = stream.withColumnRenamed("ts", "at").withWatermark("at", "1 minute")
    with cycles.rocks_state(spark):
        got = S.drained(cycles.queue(events, lease=200, unit=120), "queue_cycle", "update").collect()
    want, tasks = {}, {}
    for task, event, at, op in sorted(rows, key=lambda r: (r[2], r[1])):
        t = tasks.setdefault(task, cycles.Task(lease=200, unit=120))
        want[event] = (t.take(op, at.timestamp()), t.status, t.attempts)
    assert {r.event_id: (r.outcome, r.status, r.attempts) for r in got if r.event_id is not None} == want
    told = [r for r in got if r.event_id is None]
    assert {(r.task_id, r.outcome) for r in told} >= {(99, "recovered"), (98, "due")} and all(r.status == "pending" for r in told)
    assert {"claimed", "retry", "dead_letter", "lost", "not_due", "cancelled", "succeeded"} <= {w[0] for w in want.values()}


def test_registered_cycles_equal_loops(spark):
    from corpusmill import catalogue
    from corpusmill.plans import streams as P

    folder = "/root/testdata/sf0.001"
    events = sorted(spark.read.parquet(f"{folder}/events.parquet").select("ts", "event_id", "user_id", "event_type").collect())
    tasks, held, queue, requests = {}, {i: {} for i in range(4)}, {}, {}
    for ts, event, user, kind in events:
        now = (ts - START).total_seconds()
        t = tasks.setdefault(user, cycles.Task(lease=P.LEASE_HOURS * 3600, unit=3600))
        queue[event] = (t.take(P.QUEUE_OPS[kind], now), t.status, t.attempts)
        requests[event] = cycles.answer(held[user % 4], user, P.REQUEST_OPS[kind], str(event), now, P.TTL_HOURS * 3600, cycles.SIZE)
    assert {r.event_id: (r.outcome, r.status, r.attempts) for r in catalogue.queries()["stream_queue_cycle"](spark, folder).collect()} == queue
    assert {r.event_id: (r.outcome, r.result) for r in catalogue.queries()["stream_request_cache"](spark, folder).collect()} == requests


def test_streams_come_in_several_batches(spark):
    stream = S.in_slices(spark, "/root/testdata/sf0.001/events.parquet")
    seen = []
    run = stream.writeStream.foreachBatch(lambda b, n: seen.append(b.agg(F.min("ts"), F.max("ts"), F.count("*")).first())).trigger(availableNow=True).start()
    run.awaitTermination()
    assert len(seen) == S.SLICES and sum(r[2] for r in seen) == 1000 and all(a[1] < b[0] for a, b in zip(seen, seen[1:], strict=False))


def test_a_lease_and_a_retry_by_hand():
    t = cycles.Task()
    assert [t.take("claim", 0), t.take("enqueue", 0), t.take("enqueue", 1), t.take("claim", 2), t.take("claim", 3)] == ["not_pending", "enqueued", "known", "claimed", "not_pending"]
    assert t.take("claim", 302) == "claimed" and t.take("fail", 303) == "retry" and t.next_retry == 304
    assert [t.take("claim", 303.5), t.take("claim", 304), t.take("fail", 305)] == ["not_due", "claimed", "retry"] and t.next_retry == 307
    assert [t.take("claim", 307), t.take("fail", 308), t.take("claim", 999), t.take("enqueue", 1000)] == ["claimed", "dead_letter", "not_pending", "enqueued"]
    assert t.take("cancel", 1001) == "cancelled" and t.take("succeed", 1002) == "lost"


def test_request_cache_over_batches(spark, tmp_path):
    rng = random.Random(9)
    rows = []
    for i in range(500):
        request = rng.randrange(14)
        rows.append((request % 2, i, request, START + timedelta(seconds=9 * i + rng.randrange(9)), rng.choice(["begin", "begin", "begin", "commit", "abandon"]), f"r{i}"))
    stream = in_files(spark, f"{tmp_path}/in", cut(rows, 5), "cache long, event_id long, request_id long, ts timestamp, op string, result string")
    events = stream.withColumnRenamed("ts", "at").withWatermark("at", "1 minute")
    with cycles.rocks_state(spark):
        got = {r.event_id: (r.outcome, r.result) for r in S.drained(cycles.request_cache(events, ttl=120, size=4), "requests", "update").collect()}
    held, want = {0: {}, 1: {}}, {}
    for cache, event, request, at, op, result in sorted(rows, key=lambda r: (r[3], r[1])):
        now, known = at.timestamp(), held[cache]
        item = known.get(request)
        if item and now - item[0] > 120:
            known.pop(request)
            item = None
        if op == "begin" and item:
            want[event] = ("replay", item[1]) if item[1] else ("pending", None)
        elif op == "begin":
            if len(known) >= 4:
                known.pop(min(known, key=lambda k: (known[k][0], k)))
            known[request] = (now, None)
            want[event] = ("run", None)
        elif op == "commit":
            known[request] = (item[0] if item else now, result)
            want[event] = ("done", result)
        else:
            known.pop(request, None)
            want[event] = ("free", None)
    assert got == want and {w[0] for w in want.values()} == {"run", "pending", "replay", "done", "free"}


def test_late_rows_are_left_out(spark, tmp_path):
    at = lambda s: START + timedelta(seconds=s)
    batches = [[(1, 0, at(0), "enqueue"), (2, 1, at(1000), "enqueue")], [(1, 2, at(990), "claim")], [(1, 3, at(5), "cancel"), (1, 4, at(1200), "succeed")]]
    stream = in_files(spark, f"{tmp_path}/in", batches, "task_id long, event_id long, ts timestamp, op string")
    with cycles.rocks_state(spark):
        got = {r.event_id: r.outcome for r in S.drained(cycles.queue(stream.withColumnRenamed("ts", "at").withWatermark("at", "60 seconds")), "late", "update").collect() if r.event_id is not None}
    assert got == {0: "enqueued", 1: "enqueued", 2: "claimed", 4: "succeeded"}


def test_feed_scans(spark, tmp_path):
    schema = "source string, key string, place long"
    scan = scans.FeedScan(spark, f"file://{tmp_path}/feeds", per_source=3, remembered=5, always=("url",))
    first = spark.createDataFrame([("a", f"k{i}", i) for i in range(6)] + [("b", "k0", 0), ("b", "x", 1), ("url", "u", 0)], schema)
    keys = lambda n: sorted((r.source, r.key) for r in scan.items(schema + ", batch int").where(f"batch = {n}").collect())
    scan.scan(first, 0)
    assert keys(0) == [("a", "k0"), ("a", "k1"), ("a", "k2"), ("b", "x"), ("url", "u")]
    scan.scan(first, 1)
    assert keys(1) == [("a", "k3"), ("a", "k4"), ("a", "k5"), ("b", "k0"), ("url", "u")] or keys(1) == [("a", "k3"), ("a", "k4"), ("a", "k5"), ("url", "u")]
    again = keys(1)
    scan.scan(first, 1)
    assert keys(1) == again
    seen = scans.Numbered(spark, f"file://{tmp_path}/feeds/seen")
    assert spark.read.schema(scan.SEEN).parquet(seen.path(1)).count() == 5 and len(seen.numbers()) <= 2


def test_feed_scan_keeps_2000(spark, tmp_path):
    schema = "source string, key string, place long"
    scan = scans.FeedScan(spark, f"file://{tmp_path}/many")
    for n in range(3):
        scan.scan(spark.range(75 * 20).selectExpr("concat('s', id % 75) source", f"concat('{n}-', id) key", "id place"), n)
    got = scan.items(schema + ", batch int").groupBy("batch", "source").count()
    assert got.where("count <> 15").count() == 0 and got.count() == 225
    assert spark.read.schema(scan.SEEN).parquet(f"file://{tmp_path}/many/seen/batch=2").groupBy("scan").count().orderBy("scan").collect()[-1]["count"] == 1125


def test_repairs_are_bounded_and_none_is_lost(spark, tmp_path):
    schema = "path string, mtime long, size int"
    rng = random.Random(2)
    rows = [(f"p{rng.randrange(40)}", i, i) for i in range(90)]
    stream = in_files(spark, f"{tmp_path}/in", cut(rows, 3), schema)
    heal = scans.SelfHeal(spark, f"file://{tmp_path}/heal", schema, at_a_time=6)
    heal.start(stream, f"{tmp_path}/ck").awaitTermination()
    steps = heal.rest()
    done = heal.healed()
    sizes = [r["count"] for r in done.groupBy("batch").count().collect()]
    last = {}
    for path, mtime, _ in rows:
        last[path] = mtime
    final = {r.path: r.m for r in done.groupBy("path").agg(F.max("mtime").alias("m")).collect()}
    assert max(sizes) <= 6 and final == last and steps >= 3
    first = {r.path for r in done.where("batch = 0").collect()}
    newest = {}
    for path, mtime, _ in rows[:30]:
        newest[path] = mtime
    assert first == {p for p, _ in sorted(newest.items(), key=lambda x: -x[1])[:6]}


def test_the_oldest_request_is_found_without_a_look_at_all(spark):
    """Commits of unknown requests make a cache hold far more than its size; each new request asks for the oldest."""
    rng, plain, held, looked = random.Random(4), {}, cycles.Held(), []

    class Counted(cycles.Held):
        def __getitem__(self, request):
            looked.append(request)
            return super().__getitem__(request)

    counted = Counted()
    for i in range(4000):
        event = (rng.randrange(1500), rng.choice(["begin", "begin", "begin", "commit", "abandon"]), f"r{i}", float(i // 3), 900.0, 8)
        want = cycles.answer(plain, *event)
        assert cycles.answer(held, *event) == want == cycles.answer(counted, *event) and held == plain == counted
    assert len(plain) > 200 and len(looked) < 10 * 4000
    again = cycles.Held(dict(held))
    assert again.oldest() == min(held, key=lambda r: (held[r][0], r))


def test_state_lies_in_as_many_parts_as_asked(spark):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    with cycles.rocks_state(spark, 3):
        assert spark.conf.get("spark.sql.shuffle.partitions") == "3"
    assert spark.conf.get("spark.sql.shuffle.partitions") == before and spark.conf.get(cycles.PROVIDER) != cycles.ROCKS
