"""Governed records, similarity, synchronisation and queues. The clock is an argument."""

from __future__ import annotations

import uuid

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corpusmill.functions import text as T
from corpusmill.operators import governance as G
from corpusmill.operators.lexical import top_k
from corpusmill.operators.similarity import greedy_merges, jaccard_pairs
from corpusmill.plans.registry import query
from corpusmill.session import shared_folder
from corpusmill.sources.merging import KeyedTable
from corpusmill.sources.tables import table

NOW = "1996-06-01 00:00:00"
RECORDS = """rec AS (SELECT o_orderkey AS id, 'p' || (o_custkey % 5) AS project_id, CASE WHEN o_custkey % 3 = 0 THEN 's1' ELSE '' END AS session_id,
  CASE o_orderstatus WHEN 'O' THEN 'active' WHEN 'F' THEN 'archived' ELSE 'superseded' END AS status, o_orderdate AS valid_from,
  o_orderdate + INTERVAL 90 DAY AS valid_until, o_orderdate + INTERVAL 60 DAY AS review_due_at, (o_orderkey % 10 + 1)::INT AS importance, o_orderpriority AS tags, o_custkey AS subject,
  date_diff('day', o_orderdate::DATE, DATE '1996-06-01') AS idle FROM orders)"""
REASON = f"""CASE WHEN TIMESTAMP '{NOW}' < valid_from THEN 'not_yet_valid'
  WHEN status = 'active' AND TIMESTAMP '{NOW}' >= valid_until THEN 'status:expired'
  WHEN status = 'active' AND TIMESTAMP '{NOW}' >= review_due_at THEN 'review_due'
  WHEN status <> 'active' THEN 'status:' || status END"""


def records(spark: SparkSession, d: str) -> DataFrame:
    """Orders as records with validity, status, scope and importance."""
    status = F.when(F.col("o_orderstatus") == "O", "active").when(F.col("o_orderstatus") == "F", "archived").otherwise("superseded")
    return table(spark, d, "orders").select(
        F.col("o_orderkey").alias("id"),
        F.concat(F.lit("p"), (F.col("o_custkey") % 5).cast("string")).alias("project_id"),
        F.when(F.col("o_custkey") % 3 == 0, "s1").otherwise("").alias("session_id"),
        status.alias("status"),
        F.col("o_orderdate").alias("valid_from"),
        (F.col("o_orderdate") + F.expr("INTERVAL 90 DAY")).alias("valid_until"),
        (F.col("o_orderdate") + F.expr("INTERVAL 60 DAY")).alias("review_due_at"),
        (F.col("o_orderkey") % 10 + 1).cast("int").alias("importance"),
        F.col("o_orderpriority").alias("tags"),
        F.col("o_custkey").alias("subject"),
        F.datediff(F.lit("1996-06-01").cast("date"), F.col("o_orderdate")).alias("idle"),
    )


def now() -> F.Column:
    return F.lit(NOW).cast("timestamp_ntz")


def reason() -> F.Column:
    return G.reject_reason(F.col("status"), F.col("valid_from"), F.col("valid_until"), F.col("review_due_at"), now())


@query(f"WITH {RECORDS} SELECT id, {REASON} AS reject_reason FROM rec")
def lifecycle_status(spark: SparkSession, d: str) -> DataFrame:
    return records(spark, d).select("id", reason().alias("reject_reason"))


@query(f"""WITH {RECORDS}, r AS (SELECT CASE WHEN NOT (project_id IN ('p1', 'default') AND session_id IN ('', 's1')) THEN 'scope' ELSE {REASON} END AS reject_reason FROM rec)
SELECT coalesce(reject_reason, 'read') AS reject_reason, count(*) AS n FROM r GROUP BY 1""")
def governed_read_audit(spark: SparkSession, d: str) -> DataFrame:
    fits = G.scope_matches(F.col("project_id"), F.col("session_id"), "p1", "s1")
    why = F.when(~fits, "scope").otherwise(reason())
    return records(spark, d).groupBy(F.coalesce(why, F.lit("read")).alias("reject_reason")).agg(F.count("*").alias("n"))


@query(f"WITH {RECORDS} SELECT id, review_due_at FROM rec WHERE status = 'active' AND review_due_at <= TIMESTAMP '{NOW}' ORDER BY review_due_at, id LIMIT 50")
def review_due(spark: SparkSession, d: str) -> DataFrame:
    due = records(spark, d).where((F.col("status") == "active") & (F.col("review_due_at") <= now()))
    return due.select("id", "review_due_at").orderBy("review_due_at", "id").limit(50)


@query(f"""WITH {RECORDS}, s AS (SELECT id, round(least(10.0, 2.0 * (CASE WHEN contains(lower(tags), 'high') THEN 2 ELSE 0 END + CASE WHEN contains(lower(tags), '1') THEN 2 ELSE 0 END)) * importance / 10.0
 * pow(2.0, -greatest(idle, 0) / 30.0), 6) AS score, valid_from FROM rec) SELECT id, score FROM s WHERE score > 0 ORDER BY score DESC, valid_from DESC, id LIMIT 30""")
def memory_relevance(spark: SparkSession, d: str) -> DataFrame:
    idle = F.greatest(F.col("idle"), F.lit(0))
    score = G.relevance(F.lit(""), F.col("tags"), ["high", "1"], F.col("importance"), idle)
    found = records(spark, d).select("id", F.round(score, 6).alias("score"), "valid_from").where("score > 0")
    return found.orderBy(F.desc("score"), F.desc("valid_from"), "id").limit(30).select("id", "score")


@query(f"""WITH {RECORDS}, r AS (SELECT project_id, id, idle, row_number() OVER (PARTITION BY project_id ORDER BY importance DESC, id) AS place FROM rec QUALIFY place <= 24),
s AS (SELECT project_id, id, round(1.0 / place * pow(0.5, greatest(idle, 0) / 30.0), 8) AS score FROM r)
SELECT project_id, id, score, row_number() OVER (PARTITION BY project_id ORDER BY score DESC, id)::INT AS rank FROM s QUALIFY rank <= 8""")
def half_life_rerank(spark: SparkSession, d: str) -> DataFrame:
    """Three times the wanted rows by importance, then reordered by rank and age."""
    wide = top_k(records(spark, d), 24, ["project_id"], F.desc("importance"), "id")
    score = F.round(1.0 / F.col("rank") * F.pow(F.lit(0.5), F.greatest("idle", F.lit(0)) / 30.0), 8)
    return top_k(wide.select("project_id", "id", score.alias("score")), 8, ["project_id"], F.desc("score"), "id")


@query(f"""WITH {RECORDS} SELECT CASE WHEN status = 'superseded' THEN 'superseded' WHEN importance <= 3 AND idle > 180 THEN 'low_importance' WHEN importance <= 5 AND idle > 365 THEN 'expired' ELSE 'keep' END AS outcome,
count(*) AS n FROM rec GROUP BY 1""")
def archive_candidates(spark: SparkSession, d: str) -> DataFrame:
    why = G.archive_reason(F.col("importance"), F.col("idle"), F.col("status") == "superseded")
    return records(spark, d).groupBy(F.coalesce(why, F.lit("keep")).alias("outcome")).agg(F.count("*").alias("n"))


def conflicts(live: DataFrame) -> DataFrame:
    """(left_id, right_id) of records with one subject and project and unlike tags."""
    a, b = live.alias("a"), live.alias("b")
    same = (F.col("a.subject") == F.col("b.subject")) & (F.col("a.project_id") == F.col("b.project_id"))
    return a.join(b, same & (F.col("a.id") < F.col("b.id")) & (F.col("a.tags") != F.col("b.tags"))).select(
        F.col("a.id").alias("left_id"), F.col("b.id").alias("right_id")
    )


@query(f"""WITH {RECORDS} SELECT a.id AS left_id, b.id AS right_id FROM rec a JOIN rec b ON a.subject = b.subject AND a.project_id = b.project_id AND a.id < b.id AND a.tags <> b.tags
WHERE a.status = 'active' AND b.status = 'active'""")
def subject_conflicts(spark: SparkSession, d: str) -> DataFrame:
    """Pairs of active records of one subject and project that say different things."""
    return conflicts(records(spark, d).where("status = 'active'"))



@query(f"""WITH {RECORDS}, t AS (SELECT subject, project_id, tags, count(*) AS n, min(id) AS first FROM rec WHERE status = 'active' AND tags IS NOT NULL AND subject IS NOT NULL AND project_id IS NOT NULL GROUP BY ALL)
SELECT a.first AS left_id, b.first AS right_id, a.n AS left_n, b.n AS right_n, a.n * b.n AS pairs FROM t a JOIN t b ON a.subject = b.subject AND a.project_id = b.project_id AND a.tags < b.tags""")
def subject_conflict_groups(spark: SparkSession, d: str) -> DataFrame:
    """The first records of every two values that a subject of a project has, and how many have each: all conflicts without all pairs."""
    live = records(spark, d).where("status = 'active' AND tags IS NOT NULL AND subject IS NOT NULL AND project_id IS NOT NULL")
    own = live.groupBy("subject", "project_id", "tags").agg(F.count("*").alias("n"), F.min("id").alias("first"))
    a, b = own.alias("a"), own.alias("b")
    same = (F.col("a.subject") == F.col("b.subject")) & (F.col("a.project_id") == F.col("b.project_id")) & (F.col("a.tags") < F.col("b.tags"))
    return a.join(b, same).select(F.col("a.first").alias("left_id"), F.col("b.first").alias("right_id"), F.col("a.n").alias("left_n"), F.col("b.n").alias("right_n"), (F.col("a.n") * F.col("b.n")).alias("pairs"))


@query(f"""WITH {RECORDS} SELECT project_id, tags, id, row_number() OVER (PARTITION BY project_id, tags ORDER BY importance DESC, valid_from, id)::INT AS rank FROM rec WHERE status = 'active' QUALIFY rank <= 5""")
def memory_topics(spark: SparkSession, d: str) -> DataFrame:
    live = records(spark, d).where("status = 'active'")
    return top_k(live, 5, ["project_id", "tags"], F.desc("importance"), "valid_from", "id").select("project_id", "tags", "id", "rank")


@query(r"""WITH r AS (SELECT doc_id, CASE WHEN doc_id % 4 = 0 THEN 'core' ELSE 'fact' END AS kind, doc_id % 5 = 0 AS guess, CASE doc_id % 3 WHEN 0 THEN 'web' WHEN 1 THEN 'user' ELSE 'model' END AS src,
 regexp_matches(coalesce(text, ''), '(?i)@UNTRUSTED@') AS bad FROM documents)
SELECT doc_id, CASE WHEN src = 'web' AND bad THEN 'quarantine' WHEN kind = 'core' AND src <> 'user' THEN 'candidate' WHEN guess THEN 'candidate' ELSE 'active' END AS status,
concat_ws('|', CASE WHEN src = 'web' AND bad THEN 'external_instruction_or_secret' END, CASE WHEN kind = 'core' AND src <> 'user' AND NOT (src = 'web' AND bad) THEN 'core_requires_confirmation' END,
 CASE WHEN guess AND NOT (src = 'web' AND bad) AND NOT (kind = 'core' AND src <> 'user') THEN 'hypothesis_requires_confirmation' END) AS reasons FROM r""".replace("@UNTRUSTED@", G.UNTRUSTED))
def write_decision(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents")
    kind = F.when(F.col("doc_id") % 4 == 0, "core").otherwise("fact")
    source = F.when(F.col("doc_id") % 3 == 0, "web").when(F.col("doc_id") % 3 == 1, "user").otherwise("model")
    status, reasons = G.write_decision(F.lit(None).cast("string"), kind, F.col("doc_id") % 5 == 0, source, F.col("text"))
    return docs.select("doc_id", status.alias("status"), F.array_join(reasons, "|").alias("reasons"))


@query(r"""SELECT doc_id, regexp_matches(coalesce(text, ''), '(?i)@UNTRUSTED@') AS suspicious FROM documents""".replace("@UNTRUSTED@", G.UNTRUSTED))
def injection_quarantine(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", G.suspicious(F.col("text")).alias("suspicious"))


WORDS = r"list_distinct(regexp_extract_all(lower(text), '[\p{L}\p{N}_]+'))"


@query(f"""WITH s AS (SELECT doc_id, list_sort({WORDS}) AS t FROM documents), n AS (SELECT doc_id, t, len(t) AS n, min(doc_id) OVER (PARTITION BY t) AS f FROM s WHERE len(t) > 0),
c AS (SELECT * FROM n WHERE doc_id = f),
p AS (SELECT a.doc_id AS left_id, b.doc_id AS right_id, len(list_intersect(a.t, b.t)) AS k, a.n AS na, b.n AS nb FROM c a JOIN c b ON a.doc_id < b.doc_id AND a.n >= 0.7 * b.n AND b.n >= 0.7 * a.n)
SELECT left_id, right_id, round(k / (na + nb - k), 6) AS similarity FROM p WHERE k / (na + nb - k) > 0.7 UNION ALL SELECT f, doc_id, 1.0 FROM n WHERE doc_id > f""")
def near_duplicate_records(spark: SparkSession, d: str) -> DataFrame:
    """Pairs of unlike records over 0.7, and each record of equal words with the first one."""
    words = F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit(r"[\p{L}\p{N}_]+"), 0))
    return jaccard_pairs(table(spark, d, "documents").select(F.col("doc_id").alias("id"), words.alias("tokens")), 0.7, copies="first")


@query(f"""WITH RECURSIVE s AS (SELECT doc_id, {WORDS} AS t FROM documents), n AS (SELECT doc_id, t, len(t) AS n, doc_id % 10 + 1 AS importance FROM s WHERE len(t) > 0),
p AS (SELECT a.doc_id AS i, b.doc_id AS j, round(k / (a.n + b.n - k), 6) AS similarity FROM n a JOIN n b ON a.doc_id < b.doc_id AND a.n >= 0.7 * b.n AND b.n >= 0.7 * a.n CROSS JOIN LATERAL (SELECT len(list_intersect(a.t, b.t)) AS k) WHERE k / (a.n + b.n - k) > 0.7),
nb AS MATERIALIZED (SELECT i, row_number() OVER (ORDER BY i) AS k, list(j ORDER BY j) AS js FROM p GROUP BY i), top AS (SELECT count(*) AS m FROM nb),
fold AS (SELECT 0::BIGINT AS k, []::BIGINT[] AS gone, NULL::BIGINT AS kept, NULL::BIGINT AS discarded
 UNION ALL SELECT k, CASE WHEN j IS NULL THEN gone WHEN wi >= wj THEN list_append(gone, j) ELSE list_append(gone, i) END, CASE WHEN j IS NULL THEN NULL WHEN wi >= wj THEN i ELSE j END, CASE WHEN j IS NULL THEN NULL WHEN wi >= wj THEN j ELSE i END
 FROM (SELECT *, i % 10 AS wi, j % 10 AS wj FROM (SELECT f.k + 1 AS k, f.gone, nb.i, CASE WHEN list_contains(f.gone, nb.i) THEN NULL ELSE list_filter(nb.js, lambda x: NOT list_contains(f.gone, x))[1] END AS j FROM fold f JOIN nb ON nb.k = f.k + 1)))
SELECT kept, discarded, similarity FROM fold JOIN p ON p.i = least(kept, discarded) AND p.j = greatest(kept, discarded) WHERE kept IS NOT NULL""")
def merge_near_equal(spark: SparkSession, d: str) -> DataFrame:
    """Records over 0.7 alike merged one after the other, the more important one kept."""
    words = F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit(r"[\p{L}\p{N}_]+"), 0))
    rows = table(spark, d, "documents").select(F.col("doc_id").alias("id"), words.alias("tokens"), (F.col("doc_id") % 10 + 1).alias("importance"))
    return greedy_merges(rows, 0.7)


# --- snapshots -------------------------------------------------------------------------
CHANGED = """old AS (SELECT doc_id, sha256(text) AS h FROM documents), new AS (SELECT doc_id, sha256(CASE WHEN doc_id % 7 = 0 THEN text || ' edited' ELSE text END) AS h FROM documents WHERE doc_id % 11 <> 0
 UNION ALL SELECT doc_id + 1000000, sha256(text) FROM documents WHERE doc_id % 50 = 0)"""


def snapshots(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """The documents and a perturbed copy: edits, removals and additions."""
    docs = table(spark, d, "documents").select("doc_id", "text")
    old = docs.select("doc_id", F.sha2("text", 256).alias("h"))
    text = F.when(F.col("doc_id") % 7 == 0, F.concat("text", F.lit(" edited"))).otherwise(F.col("text"))
    new = docs.where("doc_id % 11 <> 0").select("doc_id", F.sha2(text, 256).alias("h"))
    more = docs.where("doc_id % 50 = 0").select((F.col("doc_id") + 1000000).alias("doc_id"), F.sha2("text", 256).alias("h"))
    return old, new.unionByName(more)


@query(f"""WITH {CHANGED}, one AS (SELECT coalesce(old.doc_id, new.doc_id) AS doc_id, coalesce(old.h, new.h) AS h, 1 AS seen FROM old FULL JOIN (SELECT * FROM new WHERE doc_id >= 1000000) new USING (doc_id)),
two AS (SELECT one.doc_id, CASE WHEN new.h <> one.h THEN new.h ELSE one.h END AS h, CASE WHEN new.h <> one.h THEN seen + 1 ELSE seen END AS seen FROM one LEFT JOIN new USING (doc_id)) SELECT doc_id, h, seen::INT AS seen FROM two""")
def table_merges(spark: SparkSession, d: str) -> DataFrame:
    """A stored table of hashes: new documents inserted or ignored, then changed ones updated and counted."""
    old, new = snapshots(spark, d)
    held = KeyedTable(spark, f"{shared_folder(spark)}/corpusmill/merged-{uuid.uuid4().hex}", ["doc_id"], 16)
    held.replace_all(old.withColumn("seen", F.lit(1)))
    held.merge(old.unionByName(new.where("doc_id >= 1000000")).withColumn("seen", F.lit(1)))
    held.merge(new.withColumn("seen", F.lit(1)), {"h": "new.h", "seen": "old.seen + 1"}, condition="new.h <> old.h")
    held.vacuum()
    return held.read()


def snapshot_changes(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """(key, change) of two snapshots (key, h): added, removed, changed or unchanged."""
    o, n = old.withColumnRenamed("h", "old_h"), new.withColumnRenamed("h", "new_h")
    change = F.when(F.col("old_h").isNull(), "added").when(F.col("new_h").isNull(), "removed").when(F.col("old_h") != F.col("new_h"), "changed")
    return o.join(n, key, "full_outer").select(key, change.otherwise("unchanged").alias("change"))


@query(f"""WITH {CHANGED} SELECT doc_id, CASE WHEN old.h IS NULL THEN 'added' WHEN new.h IS NULL THEN 'removed' WHEN old.h <> new.h THEN 'changed' ELSE 'unchanged' END AS change FROM old FULL JOIN new USING (doc_id)""")
def snapshot_diff(spark: SparkSession, d: str) -> DataFrame:
    return snapshot_changes(*snapshots(spark, d), "doc_id")


@query(f"WITH {CHANGED} SELECT doc_id FROM old ANTI JOIN new USING (doc_id)")
def removed_notes(spark: SparkSession, d: str) -> DataFrame:
    old, new = snapshots(spark, d)
    return old.join(new, "doc_id", "left_anti").select("doc_id")


@query(f"""WITH {CHANGED} SELECT count(*) AS expected, count(*) FILTER (new.h = old.h) AS fresh, round(count(*) FILTER (new.h = old.h) / count(*), 3) AS coverage FROM new LEFT JOIN old USING (doc_id)""")
def index_coverage(spark: SparkSession, d: str) -> DataFrame:
    old, new = snapshots(spark, d)
    fresh = F.count_if(F.col("h") == F.col("old_h"))
    joined = new.join(old.withColumnRenamed("h", "old_h"), "doc_id", "left")
    return joined.agg(F.count("*").alias("expected"), fresh.alias("fresh"), F.round(fresh / F.count("*"), 3).alias("coverage"))


@query(f"""WITH {CHANGED} SELECT new.doc_id, new.h || ':model:v1' AS cache_key, old.h IS NOT NULL AS cached FROM new LEFT JOIN old USING (h, doc_id)""")
def embedding_cache_lookup(spark: SparkSession, d: str) -> DataFrame:
    """Texts whose vectors a cache keyed by content hash, model and strategy would have."""
    old, new = snapshots(spark, d)
    hit = old.withColumn("hit", F.lit(True))
    return new.join(hit, ["doc_id", "h"], "left").select("doc_id", F.concat("h", F.lit(":model:v1")).alias("cache_key"), F.coalesce("hit", F.lit(False)).alias("cached"))


@query("""SELECT source, count(*) AS n, sha256(string_agg(doc_id || ':' || sha256(text), chr(10) ORDER BY doc_id)) AS manifest FROM documents GROUP BY source""")
def manifest_hash(spark: SparkSession, d: str) -> DataFrame:
    """A digest of each source's sorted (id, content hash) lines."""
    line = F.concat_ws(":", "doc_id", F.sha2("text", 256))
    rows = table(spark, d, "documents").select("source", "doc_id", line.alias("line"))
    return rows.repartition("source").sortWithinPartitions("source", "doc_id", "line").select("source", "line").mapInArrow(digests, "source string, n long, manifest string")


def digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(source, n, manifest) of sorted (source, line) rows, a line at a time: no row or task
    holds a source's lines."""
    own, n, state = None, 0, None

    def row() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([own], pa.string()), pa.array([n], pa.int64()), pa.array([state.hexdigest()])], names=["source", "n", "manifest"])

    for batch in batches:
        for source, line in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if state is None or source != own:
                if state:
                    yield row()
                own, n, state = source, 0, hashlib.sha256()
            state.update(("\n" if n else "").encode() + line.encode())
            n += 1
    if state:
        yield row()


@query("""WITH r AS (SELECT source, doc_id // 1000 AS part, count(*) AS n, sha256(string_agg(doc_id || ':' || sha256(text), chr(10) ORDER BY doc_id)) AS digest FROM documents GROUP BY ALL)
SELECT source, sum(n)::BIGINT AS n, sha256(string_agg(digest, chr(10) ORDER BY part)) AS manifest FROM r GROUP BY source""")
def manifest_ranges(spark: SparkSession, d: str) -> DataFrame:
    """A digest of the digests of each source's ranges of 1,000 ids: the ranges of one
    source are hashed in many tasks, which a digest of all its lines can't be."""
    line = F.concat_ws(":", "doc_id", F.sha2("text", 256))
    part = F.floor(F.col("doc_id") / 1000)
    ranges = table(spark, d, "documents").groupBy("source", part.alias("part")).agg(F.count("*").alias("n"), F.array_sort(F.collect_list(F.struct("doc_id", line.alias("l")))).alias("r"))
    ranges = ranges.select("source", "part", "n", F.sha2(F.array_join(F.col("r.l"), "\n"), 256).alias("digest"))
    rows = ranges.groupBy("source").agg(F.sum("n").alias("n"), F.array_sort(F.collect_list(F.struct("part", "digest"))).alias("r"))
    return rows.select("source", "n", F.sha2(F.array_join(F.col("r.digest"), "\n"), 256).alias("manifest"))


@query("""SELECT o_orderkey, o_orderdate FROM orders ORDER BY o_orderdate DESC, o_orderkey LIMIT 40""")
def changed_newest_first(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "orders").select("o_orderkey", "o_orderdate").orderBy(F.desc("o_orderdate"), "o_orderkey").limit(40)


# --- queues ----------------------------------------------------------------------------
STATES = "CASE event_type WHEN 'signup' THEN 'pending' WHEN 'view' THEN 'running' WHEN 'purchase' THEN 'succeeded' WHEN 'error' THEN 'failed' ELSE 'retry' END"
#: Transitions that are allowed.
ALLOWED = [
    ("pending", "running"), ("running", "succeeded"), ("running", "failed"), ("running", "retry"), ("retry", "running"), ("failed", "retry"),
]
ALLOWED_SQL = ", ".join(f"('{a}', '{b}')" for a, b in ALLOWED)


def queue_log(spark: SparkSession, d: str) -> DataFrame:
    """Events as a log of queue states, one task a user."""
    kinds = {"signup": "pending", "view": "running", "purchase": "succeeded", "error": "failed"}
    state = F.coalesce(*[F.when(F.col("event_type") == k, v) for k, v in kinds.items()], F.lit("retry"))
    return table(spark, d, "events").select("event_id", "ts", "user_id", state.alias("status"), "value")


@query(f"""SELECT {STATES} AS status, count(*) AS n, min(ts) AS first_at, max(ts) AS last_at, count(*) FILTER (value > 50) AS heavy FROM events GROUP BY 1""")
def queue_status(spark: SparkSession, d: str) -> DataFrame:
    return queue_log(spark, d).groupBy("status").agg(
        F.count("*").alias("n"), F.min("ts").alias("first_at"), F.max("ts").alias("last_at"), F.count_if(F.col("value") > 50).alias("heavy")
    )


@query(f"""WITH l AS (SELECT event_id, user_id, ts, {STATES} AS status FROM events),
p AS (SELECT *, lag(status) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS was FROM l)
SELECT was, status, count(*) AS n FROM p WHERE was IS NOT NULL AND (was, status) NOT IN ({ALLOWED_SQL}) GROUP BY ALL""")
def state_transitions_invalid(spark: SparkSession, d: str) -> DataFrame:
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    steps = queue_log(spark, d).withColumn("was", F.lag("status").over(w)).where("was IS NOT NULL")
    legal = spark.createDataFrame(ALLOWED, "was string, status string")
    return steps.join(F.broadcast(legal), ["was", "status"], "left_anti").groupBy("was", "status").agg(F.count("*").alias("n"))


@query(f"""SELECT event_id, user_id, ts FROM events WHERE {STATES} = 'pending' ORDER BY value DESC, ts, event_id LIMIT 32""")
def queue_claim_order(spark: SparkSession, d: str) -> DataFrame:
    ready = queue_log(spark, d).where("status = 'pending'")
    return ready.orderBy(F.desc("value"), "ts", "event_id").limit(32).select("event_id", "user_id", "ts")


@query(f"""WITH f AS (SELECT user_id, count(*) FILTER ({STATES} = 'failed') AS attempts FROM events GROUP BY 1)
SELECT user_id, attempts, least(3600, pow(2, least(attempts, 10)))::BIGINT AS wait_s, CASE WHEN attempts >= 8 THEN 'dead' ELSE 'retry' END AS next FROM f""")
def retry_backoff(spark: SparkSession, d: str) -> DataFrame:
    fails = queue_log(spark, d).groupBy("user_id").agg(F.count_if(F.col("status") == "failed").alias("attempts"))
    wait = F.least(F.lit(3600), F.pow(F.lit(2), F.least("attempts", F.lit(10)))).cast("bigint")
    return fails.select("user_id", "attempts", wait.alias("wait_s"), F.when(F.col("attempts") >= 8, "dead").otherwise("retry").alias("next"))


@query(f"""WITH l AS (SELECT user_id, arg_max({STATES}, (ts, event_id)) AS status, max(ts) AS last_at FROM events GROUP BY 1)
SELECT user_id, CASE WHEN status = 'running' AND last_at + INTERVAL 300 SECOND <= TIMESTAMP '2024-01-30 00:00:00' THEN 'pending' ELSE status END AS status FROM l""")
def lease_recovery(spark: SparkSession, d: str) -> DataFrame:
    """The last state of each task; a lease of 300 s that ran out goes back to pending."""
    last = queue_log(spark, d).groupBy("user_id").agg(F.max(F.struct("ts", "event_id", "status")).alias("m"))
    over = F.col("m.ts") + F.expr("INTERVAL 300 SECOND") <= F.lit("2024-01-30 00:00:00").cast("timestamp_ntz")
    return last.select("user_id", F.when((F.col("m.status") == "running") & over, "pending").otherwise(F.col("m.status")).alias("status"))


@query("""SELECT event_type, k, event_id FROM (SELECT event_type, event_id, (props::JSON->>'k')::INT AS k FROM events) QUALIFY row_number() OVER (PARTITION BY event_type, k ORDER BY event_id) = 1""")
def idempotent_insert(spark: SparkSession, d: str) -> DataFrame:
    """Insert-or-ignore: the first row of each key stays."""
    k = F.get_json_object("props", "$.k").cast("int")
    first = table(spark, d, "events").groupBy("event_type", k.alias("k")).agg(F.min("event_id").alias("event_id"))
    return first


@query("""SELECT user_id, event_type, event_id, value FROM events QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) = 1""")
def upsert_latest(spark: SparkSession, d: str) -> DataFrame:
    """Insert-or-replace: the last row of each key stays."""
    last = table(spark, d, "events").groupBy("user_id", "event_type").agg(F.max(F.struct("ts", "event_id", "value")).alias("m"))
    return last.select("user_id", "event_type", "m.event_id", "m.value")


@query("""SELECT user_id, count(*) AS events, min(ts) AS started, max(ts) AS ended, count(*) FILTER (event_type = 'error') AS errors, arg_max(event_type, (ts, event_id)) AS last_type, round(sum(value), 4) AS total FROM events GROUP BY user_id""")
def run_summaries(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").groupBy("user_id").agg(
        F.count("*").alias("events"), F.min("ts").alias("started"), F.max("ts").alias("ended"), F.count_if(F.col("event_type") == "error").alias("errors"),
        F.max(F.struct("ts", "event_id", "event_type"))["event_type"].alias("last_type"), F.round(F.sum("value"), 4).alias("total"),
    )


@query("""SELECT user_id, event_id FROM (SELECT user_id, event_id, event_type, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS was FROM events) WHERE was = event_type""")
def tool_call_loops(spark: SparkSession, d: str) -> DataFrame:
    """Calls that repeat the call before."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    return table(spark, d, "events").withColumn("was", F.lag("event_type").over(w)).where("was = event_type").select("user_id", "event_id")


@query("""WITH t AS (SELECT conv_id, turn, role, greatest(1, ceil(length(coalesce(text, '')) / 4))::BIGINT AS tokens FROM conversations),
b AS (SELECT *, sum(tokens) OVER (PARTITION BY conv_id ORDER BY turn DESC) AS behind FROM t)
SELECT conv_id, min(turn) AS cut_turn, sum(tokens)::BIGINT AS kept_tokens FROM b WHERE behind <= 400 GROUP BY conv_id""")
def token_budget_cut(spark: SparkSession, d: str) -> DataFrame:
    """The earliest turn from which the rest of a conversation fits the budget."""
    w = Window.partitionBy("conv_id").orderBy(F.desc("turn"))
    turns = table(spark, d, "conversations").withColumn("tokens", T.estimated_tokens(F.col("text"))).withColumn("behind", F.sum("tokens").over(w))
    return turns.where("behind <= 400").groupBy("conv_id").agg(F.min("turn").alias("cut_turn"), F.sum("tokens").alias("kept_tokens"))


@query("""WITH b AS (SELECT conv_id, turn, role, sum(length(coalesce(text, ''))) OVER (PARTITION BY conv_id ORDER BY turn DESC) - length(coalesce(text, '')) AS after_chars FROM conversations)
SELECT conv_id, turn, after_chars >= 1000 AND role = 'assistant' AS masked FROM b""")
def observation_mask(spark: SparkSession, d: str) -> DataFrame:
    """Outputs older than a budget of later text are masked."""
    w = Window.partitionBy("conv_id").orderBy(F.desc("turn"))
    size = F.length(F.coalesce("text", F.lit("")))
    after = F.sum(size).over(w) - size
    return table(spark, d, "conversations").select("conv_id", "turn", ((after >= 1000) & (F.col("role") == "assistant")).alias("masked"))


@query("""SELECT conv_id, turn, regexp_matches(lower(text), 'that|tion|ein|que') AS captured FROM conversations WHERE role = 'user'""")
def trigger_capture(spark: SparkSession, d: str) -> DataFrame:
    """Whether each turn of the user holds a trigger."""
    return table(spark, d, "conversations").where("role = 'user'").select("conv_id", "turn", F.lower("text").rlike("that|tion|ein|que").alias("captured"))



@query("""SELECT user_id, event_id, version::INT AS version, supersedes FROM (SELECT user_id, event_id, row_number() OVER w AS version, lag(event_id) OVER w AS supersedes FROM events WINDOW w AS (PARTITION BY user_id, event_type ORDER BY ts, event_id))""")
def artifact_versions(spark: SparkSession, d: str) -> DataFrame:
    w = Window.partitionBy("user_id", "event_type").orderBy("ts", "event_id")
    return table(spark, d, "events").select("user_id", "event_id", F.row_number().over(w).alias("version"), F.lag("event_id").over(w).alias("supersedes"))


@query("""SELECT event_type, event_id FROM events QUALIFY row_number() OVER (PARTITION BY event_type ORDER BY ts DESC, event_id DESC) <= 200""")
def keep_latest_n(spark: SparkSession, d: str) -> DataFrame:
    return top_k(table(spark, d, "events"), 200, ["event_type"], F.desc("ts"), F.desc("event_id")).select("event_type", "event_id")
