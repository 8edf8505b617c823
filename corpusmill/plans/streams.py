"""Stream queries, run over the events there are, with the batch result as SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusmill.plans.registry import query
from corpusmill.sources.tables import table
from corpusmill.streaming import cycles, scans
from corpusmill.streaming import streams as S


def source(spark: SparkSession, d: str) -> DataFrame:
    """The events in several batches, in the order of time."""
    return S.timed(S.in_slices(spark, f"{d}/events.parquet"))


def name(prefix: str) -> str:
    return f"{prefix}_{uuid.uuid4().hex}"


@query("SELECT event_type, user_id FROM events GROUP BY ALL")
def stream_dedupe(spark: SparkSession, d: str) -> DataFrame:
    out = S.deduplicated(source(spark, d), ["event_type", "user_id"]).select("event_type", "user_id")
    return S.drained(out, name("dedupe"), "append")


@query("SELECT date_trunc('day', ts)::TIMESTAMP AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def stream_tumbling(spark: SparkSession, d: str) -> DataFrame:
    out = S.drained(S.tumbling(source(spark, d)), name("tumbling"), "complete")
    return out.withColumn("start", F.col("start").cast("timestamp_ntz"))


@query("""WITH e AS (SELECT ts, unnest(generate_series(0, 6)) AS k FROM events) SELECT (date_trunc('day', ts) - to_days(k::INT))::TIMESTAMP AS start, count(*) AS n FROM e GROUP BY ALL""")
def stream_sliding(spark: SparkSession, d: str) -> DataFrame:
    out = S.drained(S.sliding(source(spark, d)), name("sliding"), "complete")
    return out.withColumn("start", F.col("start").cast("timestamp_ntz"))


@query("""WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 6 HOUR THEN 0 ELSE 1 END AS new FROM events),
s AS (SELECT user_id, ts, sum(new) OVER (PARTITION BY user_id ORDER BY ts) AS session FROM g) SELECT user_id, min(ts) AS started, count(*) AS n FROM s GROUP BY user_id, session""")
def stream_sessions(spark: SparkSession, d: str) -> DataFrame:
    out = S.drained(S.debounced(source(spark, d)), name("sessions"), "complete")
    return out.withColumn("started", F.col("started").cast("timestamp_ntz"))


@query()
def stream_queue(spark: SparkSession, d: str) -> DataFrame:
    """The last state of each key; the order-dependent fold has no SQL, a batch fold tests it."""
    out = S.drained(S.task_states(source(spark, d)), name("queue"), "update")
    return out.groupBy("user_id").agg(F.max(F.struct(F.col("moves") + F.col("ignored"), "status", "moves", "ignored"))["status"].alias("status"), F.max("moves").alias("moves"), F.max("ignored").alias("ignored"))


#: What an event does to its user's task, and to the request of its user.
QUEUE_OPS = {"signup": "enqueue", "view": "claim", "purchase": "succeed", "error": "fail", "click": "claim"}
REQUEST_OPS = {"signup": "begin", "view": "begin", "click": "begin", "purchase": "commit", "error": "abandon"}
LEASE_HOURS, TTL_HOURS = 12, 48
#: Caches of requests, and the tasks that they are dealt to.
CACHES, CACHE_TASKS = 4, 16


def op_of(ops: dict[str, str]) -> Column:
    out = F
    for kind, op in ops.items():
        out = out.when(F.col("event_type") == kind, op)
    return out.alias("op")


@query()
def stream_queue_cycle(spark: SparkSession, d: str) -> DataFrame:
    """A task a user: enqueued, claimed with a lease, finished, tried again after a wait, given up; what each event met."""
    events = source(spark, d).select(F.col("user_id").alias("task_id"), "event_id", "at", op_of(QUEUE_OPS))
    with cycles.rocks_state(spark):
        out = S.drained(cycles.queue(events, lease=LEASE_HOURS * 3600, unit=3600), name("queue_cycle"), "update")
    return out.where("event_id IS NOT NULL").select("task_id", "event_id", "outcome", "status", "attempts")


@query()
def stream_request_cache(spark: SparkSession, d: str) -> DataFrame:
    """A request a user, in four caches: who has to do it, who waits, who gets the known result."""
    n = F.col("user_id")
    events = source(spark, d).select((n % CACHES).alias("cache"), "event_id", n.alias("request_id"), "at", op_of(REQUEST_OPS), F.col("event_id").cast("string").alias("result"))
    with cycles.rocks_state(spark, CACHE_TASKS):
        out = S.drained(cycles.request_cache(events, ttl=TTL_HOURS * 3600), name("requests"), "update")
    return out.select("event_id", "request_id", "outcome", "result")


@query("""SELECT source, doc_id::VARCHAR AS key, doc_id AS place, ((rn - 1) // 15)::INT AS batch FROM (SELECT source, doc_id, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS rn FROM documents) WHERE rn <= 45""")
def feed_scans(spark: SparkSession, d: str) -> DataFrame:
    """Three scans of the sources: fifteen new documents of each at a time."""
    items = table(spark, d, "documents").select("source", F.col("doc_id").cast("string").alias("key"), F.col("doc_id").alias("place"))
    scan = scans.FeedScan(spark, S.scratch(spark, "feeds"))
    for number in range(3):
        scan.scan(items, number)
    return scan.items("source string, key string, place long, batch int")


@query("""WITH c AS (SELECT source || '/' || doc_id AS path, doc_id * 7 % 1000 AS mtime FROM documents), n AS (SELECT (count(*) + 5) // 6 AS most FROM c)
SELECT path, mtime, ((row_number() OVER (ORDER BY mtime DESC, path) - 1) // most)::INT AS batch FROM c, n""")
def self_heal(spark: SparkSession, d: str) -> DataFrame:
    """A burst of changes repaired newest first, a sixth at a time."""
    changes = table(spark, d, "documents").select(F.concat_ws("/", "source", "doc_id").alias("path"), (F.col("doc_id") * 7 % 1000).alias("mtime"))
    heal = scans.SelfHeal(spark, S.scratch(spark, "heal"), "path string, mtime long", at_a_time=max(1, (changes.count() + 5) // 6))
    heal.step(changes, 0)
    heal.rest()
    return heal.healed()
