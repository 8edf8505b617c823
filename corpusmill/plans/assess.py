"""Questions and their kinds, route sweeps, audits, gates and session folds, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corpusmill.functions import queries as Q
from corpusmill.functions import text as T
from corpusmill.operators import evaluation as E
from corpusmill.operators import selection as S
from corpusmill.operators import sessions
from corpusmill.operators.lexical import FIELD_WEIGHTS, rescued_topk, top_k
from corpusmill.operators.ranking import document_terms, hashed
from corpusmill.operators.selection import expanded_context, packed_context
from corpusmill.operators.similarity import best_coverage
from corpusmill.operators.vectors import cosine_topk
from corpusmill.plans.evaluations import JUDGED, MTOK, QRELS, qrels
from corpusmill.plans.hybrid import corpus_vectors, questions
from corpusmill.plans.records import CHANGED, RECORDS, records, snapshots
from corpusmill.plans.registry import query
from corpusmill.plans.retrieval import FIELDS, ROUTES, TOKENS_SQL, as_notes, routes
from corpusmill.plans.web import EDGE, edges
from corpusmill.sources.tables import table

SQUEEZED = r"trim(regexp_replace(coalesce(text, ''), '\s+', ' ', 'g'))"


#: Letters beyond ASCII of Latin, Greek, Cyrillic, Chinese, Japanese and Korean: DuckDB's \\b knows ASCII words only, so where such a
#: letter meets a word of ASCII a mark stands, and a find that touches a mark is none.
BEYOND = r"[\x{AA}\x{B5}\x{BA}\x{C0}-\x{D6}\x{D8}-\x{F6}\x{F8}-\x{2FF}\x{370}-\x{3FF}\x{400}-\x{52F}\x{3040}-\x{30FF}\x{3400}-\x{9FFF}\x{AC00}-\x{D7A3}]"
MARKED = rf"regexp_replace(regexp_replace(@, '([A-Za-z0-9_])({BEYOND})', '\1' || chr(1) || '\2', 'g'), '({BEYOND})([A-Za-z0-9_])', '\1' || chr(1) || '\2', 'g')"


def finds(c: str, pattern: str) -> str:
    """A list of what ``pattern`` finds in ``c``, between word bounds by Unicode."""
    quoted = pattern.replace("'", "''")
    every = rf"regexp_extract_all({MARKED.replace("@", c)}, '\x01?{quoted}\x01?')".replace("\x01?(?i)", "(?i)\x01?")
    return rf"list_transform(list_filter({every}, lambda w: NOT starts_with(w, chr(1)) AND NOT ends_with(w, chr(1))), lambda w: regexp_replace(replace(w, chr(1), ''), '^\s+|\s+$', '', 'g'))"


def entities(c: str) -> str:
    return f"list_concat(list_concat({finds(c, '(?i)' + Q.IDENTIFIER)}, {finds(c, Q.ACRONYM)}), {finds(c, Q.NUMBER)})"


def says(pattern: str) -> str:
    return "regexp_matches(t, '(?i){}')".format(pattern.replace("'", "''"))


KIND = rf"""CASE WHEN t = '' THEN 'empty' WHEN len({entities("t")}) > 0 AND (len({finds("t", "(?i)" + Q.STRONG)}) > 0 OR (length(t) <= {Q.EXACT_LENGTH} AND len({finds("t", Q.NUMBER)}) > 0)) THEN 'identifier'
 WHEN {says(Q.FOLLOW_UP)} AND length(t) <= {Q.FOLLOW_UP_LENGTH} THEN 'followup' WHEN {says(Q.ABSENCE)} THEN 'negative'
 WHEN {says(Q.JOINED.replace("|\\band\\b", ""))} OR len({finds("t", "(?i)(?:" + chr(92) + "band" + chr(92) + "b)")}) > 0 OR length(t) - length(translate(t, '?？', '')) > 1 THEN 'multi_hop' ELSE 'natural' END"""
SURE = "CASE kind " + " ".join(f"WHEN '{k}' THEN {v}::DOUBLE" for k, v in Q.CONFIDENCE.items()) + " END"


@query(f"WITH s AS (SELECT conv_id, turn, {SQUEEZED} AS t FROM conversations WHERE role = 'user'), k AS (SELECT conv_id, turn, {KIND} AS kind FROM s) SELECT conv_id, turn, kind, {SURE} AS confidence FROM k")
def question_kinds(spark: SparkSession, d: str) -> DataFrame:
    """What kind of question each turn of a user is, and how sure that is."""
    kinds = table(spark, d, "conversations").where("role = 'user'").select("conv_id", "turn", Q.question_kind(F.col("text")).alias("kind"))
    return kinds.withColumn("confidence", Q.kind_confidence(F.col("kind")))


@query(f"""WITH e AS (SELECT conv_id, turn, {entities("coalesce(text, '')")} AS f FROM conversations),
l AS (SELECT conv_id, turn, list_filter(f, lambda x: x <> '') AS f FROM e), m AS (SELECT *, list_transform(f, lambda x: lower(x)) AS low FROM l)
SELECT conv_id, turn, array_to_string(list_filter(f, lambda x, i: list_position(low, lower(x)) = i)[1:{Q.MOST_KEPT}], '|') AS entities FROM m""")
def preserved_entities(spark: SparkSession, d: str) -> DataFrame:
    """Names, acronyms and numbers that a rewrite of a turn has to keep."""
    return table(spark, d, "conversations").select("conv_id", "turn", F.array_join(Q.kept_entities(F.col("text")), "|").alias("entities"))


TASK_KIND = f"k AS (SELECT item_id AS task_id, {KIND} AS kind FROM (SELECT item_id, {SQUEEZED} AS t FROM benchmark))"


def task_kinds(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "benchmark").select(F.col("item_id").alias("task_id"), Q.question_kind(F.col("text")).alias("kind"))


STOP_SQL, GENERIC_SQL = ("(" + ", ".join(f"'{w}'" for w in words) + ")" for words in (S.STOPWORDS, S.GENERIC))


@query(rf"""WITH k AS (SELECT query_id, t, {KIND} AS kind FROM (SELECT item_id AS query_id, {SQUEEZED} AS t FROM benchmark)),
b AS (SELECT query_id, t AS asked, trim(regexp_replace(t, '{S.QUESTION_PREFIX}', '')) AS cleaned FROM k WHERE kind NOT IN ('empty', 'identifier', 'negative')),
c AS (SELECT *, CASE WHEN cleaned = '' THEN asked ELSE cleaned END AS base FROM b), w AS (SELECT *, regexp_extract_all(base, '{T.KEYWORD}') AS ws FROM c),
x AS (SELECT *, list_filter(list_filter(ws, lambda w, i: list_position(list_transform(ws, lambda y: lower(y)), lower(w)) = i), lambda w: lower(w) NOT IN {STOP_SQL} AND (length(w) >= 2 OR regexp_matches(w, '{S.ASCII_WORD}'))) AS toks,
 list_transform(list_sort(list_transform(list_distinct(list_filter(string_split_regex(base, '{S.PARTS}'), lambda s: length(s) >= 3)), lambda s: struct_pack(n := -length(s), v := s))), lambda s: s.v) AS segs FROM w),
e AS (SELECT query_id, asked, list_transform(list_concat(list_concat(CASE WHEN cleaned <> asked THEN [cleaned] ELSE [] END, segs), list_concat(CASE WHEN len(toks) >= 2 THEN [array_to_string(toks, ' ')] ELSE [] END, list_filter(toks, lambda w: regexp_matches(w, '{S.ASCII_WORD}') AND length(w) >= 3 AND lower(w) NOT IN {GENERIC_SQL}))),
 lambda v: regexp_replace(trim(regexp_replace(v, '\s+', ' ', 'g')), '{S.STRIPPED}', '', 'g')) AS vs FROM x),
f AS (SELECT query_id, list_filter(vs, lambda v, i: length(v) >= 2 AND lower(v) <> lower(asked) AND list_position(list_transform(vs, lambda y: lower(y)), lower(v)) = i)[1:5] AS vs FROM e)
SELECT query_id, (generate_subscripts(vs, 1) - 1)::INT AS place, unnest(vs) AS variant FROM f""")
def query_variants(spark: SparkSession, d: str) -> DataFrame:
    """Other ways to ask each benchmark item."""
    return S.query_variants(table(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), "text"))


VARIANT = "unnest(['ref', 'entry', 'file']) AS variant"
REPLAY = f"""{ROUTES}, {QRELS}, {TASK_KIND}, v AS (SELECT query_id AS task_id, a.doc_id, rank, lang, source, {VARIANT} FROM a JOIN documents USING (doc_id)),
c AS (SELECT variant, task_id, doc_id, rank, CASE variant WHEN 'ref' THEN doc_id::VARCHAR WHEN 'entry' THEN source || '#' || lang ELSE source END AS key FROM v),
f AS (SELECT * FROM c QUALIFY row_number() OVER (PARTITION BY variant, task_id, key ORDER BY rank) = 1),
p AS (SELECT *, row_number() OVER (PARTITION BY variant, task_id ORDER BY rank) AS place FROM f),
n AS (SELECT task_id, count(*) AS relevant FROM qrels GROUP BY 1),
m AS (SELECT variant, p.task_id, count(q.ref) FILTER (place <= 5) AS hit5, count(q.ref) FILTER (place <= 10) AS hit10, min(place) FILTER (q.ref IS NOT NULL AND place <= 10) AS first FROM p LEFT JOIN qrels q ON q.task_id = p.task_id AND q.ref = p.doc_id GROUP BY ALL)"""


@query(f"""WITH {REPLAY} SELECT kind, variant, count(*) AS tasks, round(avg(hit5 / relevant), 4) AS recall5, round(avg(hit10 / relevant), 4) AS recall10, round(avg(coalesce(1.0 / first, 0)), 4) AS mrr
FROM m JOIN n USING (task_id) JOIN k USING (task_id) GROUP BY ALL""")
def lexical_sweep(spark: SparkSession, d: str) -> DataFrame:
    """One route's list replayed with repeats dropped by reference, entry or file, by kind of question."""
    docs = table(spark, d, "documents").select("doc_id", "lang", "source")
    key = F.when(F.col("variant") == "ref", F.col("doc_id").cast("string")).when(F.col("variant") == "entry", F.concat("source", F.lit("#"), "lang")).otherwise(F.col("source"))
    listed = routes(spark, d).where("route = 'content'").join(docs, "doc_id").withColumn("variant", F.explode(F.array(*map(F.lit, ("ref", "entry", "file"))))).withColumn("key", key)
    first = listed.groupBy("variant", "query_id", "key").agg(F.min(F.struct("rank", "doc_id")).alias("m"))
    placed = first.select("variant", F.col("query_id").alias("task_id"), F.col("m.doc_id").alias("ref"), F.row_number().over(Window.partitionBy("variant", "query_id").orderBy("m.rank")).alias("place"))
    good = qrels(spark, d).withColumn("good", F.lit(True))
    hit = F.col("good").isNotNull()
    per = placed.join(good, ["task_id", "ref"], "left").groupBy("variant", "task_id").agg(
        F.count_if(hit & (F.col("place") <= 5)).alias("hit5"), F.count_if(hit & (F.col("place") <= 10)).alias("hit10"), F.min(F.when(hit & (F.col("place") <= 10), F.col("place"))).alias("first")
    )
    relevant = good.groupBy("task_id").agg(F.count("*").alias("relevant"))
    mean = lambda c: F.round(F.avg(c), 4)
    return per.join(relevant, "task_id").join(task_kinds(spark, d), "task_id").groupBy("kind", "variant").agg(
        F.count("*").alias("tasks"), mean(F.col("hit5") / F.col("relevant")).alias("recall5"), mean(F.col("hit10") / F.col("relevant")).alias("recall10"), mean(F.coalesce(1.0 / F.col("first"), F.lit(0.0))).alias("mrr")
    )


INDEXED = "doc_id % 11 <> 0"


@query(f"""WITH {QRELS}, s AS (SELECT task_id, count(*) AS expected, count(*) FILTER (ref % 11 <> 0) AS inside FROM qrels GROUP BY 1)
SELECT item_id AS task_id, CASE WHEN expected IS NULL THEN 'negative' WHEN inside = expected THEN 'in_scope' WHEN inside = 0 THEN 'out_of_scope' ELSE 'mixed_scope' END AS category,
coalesce(expected, 0) AS expected, coalesce(inside, 0) AS in_scope FROM benchmark LEFT JOIN s ON item_id = task_id""")
def scope_audit(spark: SparkSession, d: str) -> DataFrame:
    """Which tasks' references an index that lacks some documents can give."""
    index = table(spark, d, "documents").where(INDEXED).select(F.col("doc_id").alias("ref"), F.lit(True).alias("held"))
    refs = qrels(spark, d).join(index, "ref", "left").groupBy("task_id").agg(F.count("*").alias("expected"), F.count_if(F.col("held")).alias("in_scope"))
    tasks = table(spark, d, "benchmark").select(F.col("item_id").alias("task_id")).join(refs, "task_id", "left").na.fill(0)
    category = F.when(F.col("expected") == 0, "negative").when(F.col("in_scope") == F.col("expected"), "in_scope").when(F.col("in_scope") == 0, "out_of_scope").otherwise("mixed_scope")
    return tasks.select("task_id", category.alias("category"), "expected", "in_scope")


@query(f"""WITH {QRELS}, {TASK_KIND}, s AS (SELECT DISTINCT task_id FROM qrels)
SELECT kind, CASE WHEN s.task_id IS NULL THEN 'negative' ELSE 'positive' END AS scope, count(*) AS n FROM k LEFT JOIN s USING (task_id) GROUP BY ALL""")
def task_set_audit(spark: SparkSession, d: str) -> DataFrame:
    """How many tasks there are of each kind, with and without references."""
    some = qrels(spark, d).select("task_id").distinct().withColumn("scope", F.lit("positive"))
    return task_kinds(spark, d).join(some, "task_id", "left").groupBy("kind", F.coalesce("scope", F.lit("negative")).alias("scope")).agg(F.count("*").alias("n"))


@query("""WITH s AS (SELECT source, avg(quality) * 5 AS q, avg(1 - toxic) * 5 AS c, count(*) AS n FROM documents JOIN labels USING (doc_id) GROUP BY 1)
SELECT source, n, round(q, 3) AS quality_0_5, round(c, 3) AS clean_0_5, round(round(q, 3) / 5, 3) AS quality_0_1, round(round(c, 3) / 5, 3) AS clean_0_1,
round((round(round(q, 3) / 5, 3) + round(round(c, 3) / 5, 3)) / 2, 3) AS overall FROM s""")
def rubric_means(spark: SparkSession, d: str) -> DataFrame:
    """Means of two marks of 0 to 5, and of them over 5."""
    marks = table(spark, d, "labels").select("doc_id", (F.col("quality") * 5).alias("q"), ((1 - F.col("toxic")) * 5).alias("c"))
    s = table(spark, d, "documents").select("doc_id", "source").join(marks, "doc_id").groupBy("source").agg(F.count("*").alias("n"), F.round(F.avg("q"), 3).alias("quality_0_5"), F.round(F.avg("c"), 3).alias("clean_0_5"))
    s = s.withColumns({"quality_0_1": F.round(F.col("quality_0_5") / 5, 3), "clean_0_1": F.round(F.col("clean_0_5") / 5, 3)})
    return s.withColumn("overall", F.round((F.col("quality_0_1") + F.col("clean_0_1")) / 2, 3))


@query()
def context_plan_metrics(spark: SparkSession, d: str) -> DataFrame:
    """What the packing of each conversation took and left, by zone; the fold has no SQL, hand-made values test it."""
    rows = table(spark, d, "conversations").select(
        F.col("conv_id").alias("request"), F.col("turn").alias("id"), (F.col("role") == "system").alias("required"), (F.col("turn") % 3).cast("int").alias("priority"),
        F.length(F.coalesce("text", F.lit(""))).cast("double").alias("score"), F.col("role").alias("zone"), T.estimated_tokens(F.col("text")).cast("int").alias("tokens"),
    )
    taken = packed_context(rows, 400, 250).select("request", "id", F.lit(True).alias("taken"))
    marked = rows.join(taken, ["request", "id"], "left")
    reason = F.when(F.col("taken"), "selected").when(F.col("tokens") > 400, "over_budget").otherwise("budget_used")
    return marked.groupBy("zone", reason.alias("reason")).agg(F.count("*").alias("n"), F.sum("tokens").alias("tokens"))


@query(f"WITH {RECORDS} SELECT project_id, session_id, count(*) AS n, max(valid_from) AS max_updated FROM rec GROUP BY ALL")
def scope_signature(spark: SparkSession, d: str) -> DataFrame:
    """Count and last change of each scope: what tells whether a cache still holds."""
    return records(spark, d).groupBy("project_id", "session_id").agg(F.count("*").alias("n"), F.max("valid_from").alias("max_updated"))


@query("""WITH c AS (SELECT conv_id, turn, coalesce(text, '') AS t, count(*) OVER (PARTITION BY conv_id) AS n FROM conversations),
s AS (SELECT *, least(floor(greatest(0, 2000 - 24 * n) / n), length(t))::INT AS share FROM c)
SELECT conv_id, turn, share, CASE WHEN length(t) > share THEN left(t, share - share // 4) || '…' || right(t, share // 4) ELSE t END AS evidence FROM s""")
def evidence_shares(spark: SparkSession, d: str) -> DataFrame:
    """Each call of a conversation shows its even share of the budget, head and tail."""
    calls = sessions.fair_shares(table(spark, d, "conversations"), "conv_id", "text", 2000, 24)
    t, tail = F.coalesce("text", F.lit("")), F.floor(F.col("share") / 4).cast("int")
    cut = F.concat(F.left(t, F.col("share") - tail), F.lit("…"), F.right(t, tail))
    return calls.select("conv_id", "turn", "share", F.when(F.length(t) > F.col("share"), cut).otherwise(t).alias("evidence"))


@query("""WITH c AS (SELECT doc_id, source, (length(text) - length(replace(text, 'tion', ''))) / 4 AS score FROM documents)
SELECT doc_id, source, score::BIGINT AS score FROM c WHERE score > 0 ORDER BY score DESC, source DESC, doc_id DESC LIMIT 20""")
def legacy_search_order(spark: SparkSession, d: str) -> DataFrame:
    """Score, path and number, all descending."""
    hits = table(spark, d, "documents").select("doc_id", "source", T.occurrences(F.col("text"), "tion").alias("score")).where("score > 0")
    return hits.orderBy(F.desc("score"), F.desc("source"), F.desc("doc_id")).limit(20)


RANGES = """t AS (SELECT conv_id, turn, coalesce(text, '') AS text, greatest(1, ceil(length(coalesce(text, '')) / 4))::BIGINT AS tokens FROM conversations),
b AS (SELECT *, (floor(coalesce(sum(tokens) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) / 200) + 1)::INT AS seq FROM t),
r AS (SELECT conv_id, seq, min(turn) AS first_turn, max(turn) AS last_turn, sum(tokens)::BIGINT AS tokens, string_agg(text, chr(10) ORDER BY turn) AS body FROM b GROUP BY ALL)"""


def ranges(spark: SparkSession, d: str) -> DataFrame:
    turns = table(spark, d, "conversations").select("conv_id", "turn", F.coalesce("text", F.lit("")).alias("text"), T.estimated_tokens(F.col("text")).alias("tokens"))
    cut = sessions.folded_ranges(turns, "conv_id", "turn", "tokens", 200)
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", "text"))), lambda x: x["text"]), "\n")
    return cut.groupBy("conv_id", "seq").agg(F.min("turn").alias("first_turn"), F.max("turn").alias("last_turn"), F.sum("tokens").alias("tokens"), body.alias("body"))


@query(f"WITH {RANGES} SELECT conv_id, seq, first_turn, last_turn, tokens, md5(body) AS digest FROM r")
def range_fold(spark: SparkSession, d: str) -> DataFrame:
    """Each conversation's log in ranges of 200 tokens."""
    return ranges(spark, d).withColumn("digest", F.md5("body")).drop("body")


@query(f"""WITH {RANGES}, s AS (SELECT conv_id, seq, len(list_filter(['that', 'tion', 'ein', 'que'], lambda w: contains(lower(body), w)))::INT AS score FROM r)
SELECT conv_id, seq, score, row_number() OVER (PARTITION BY conv_id ORDER BY score DESC, seq)::INT AS rank FROM s WHERE score > 0 QUALIFY rank <= 5""")
def range_search(spark: SparkSession, d: str) -> DataFrame:
    """Ranges by the number of terms that they hold, then in order."""
    score = sum((F.contains(F.lower("body"), F.lit(w)).cast("int") for w in ("that", "tion", "ein", "que")), F.lit(0))
    found = ranges(spark, d).select("conv_id", "seq", score.alias("score")).where("score > 0")
    return top_k(found, 5, ["conv_id"], F.desc("score"), "seq")


FUSED = f"""{ROUTES}, f AS (SELECT query_id, doc_id, sum(1.0::DOUBLE / (60 + rank)) AS rrf, min(struct_pack(o := CASE route WHEN 'content' THEN 0 ELSE 1 END, r := rank)) AS arrival FROM routes GROUP BY ALL),
kw AS (SELECT query_id, list_filter(w, lambda x, i: list_position(w, x) = i)[1:6] AS words FROM (SELECT item_id AS query_id, regexp_extract_all(lower(split_part(text, chr(10), 1)), '[a-z]{{5,}}') AS w FROM benchmark)),
h AS (SELECT f.*, list_sum(list_transform(words, lambda w: CASE WHEN contains(lower(split_part(text, chr(10), 1)), w) THEN 3 WHEN contains(lower(text), w) THEN 1 ELSE 0 END)) AS hit FROM f JOIN kw USING (query_id) JOIN documents USING (doc_id))"""


def with_hits(spark: SparkSession, d: str, fused: DataFrame) -> DataFrame:
    """``fused`` (query_id, doc_id, ...) with ``hit``: 3 for each word of the question in the title, else 1 in the text."""
    words = F.slice(F.array_distinct(F.regexp_extract_all(F.lower(F.substring_index("text", "\n", 1)), F.lit("[a-z]{5,}"), 0)), 1, 6)
    asked = table(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), words.alias("words"))
    docs = table(spark, d, "documents").select("doc_id", F.lower("text").alias("body"), F.lower(F.substring_index("text", "\n", 1)).alias("title"))
    one = F.transform("words", lambda w: F.when(F.contains("title", w), 3).when(F.contains("body", w), 1).otherwise(0))
    return fused.join(docs, "doc_id").join(asked, "query_id").withColumn("hit", F.aggregate(one, F.lit(0), lambda s, x: s + x)).drop("words", "body", "title")


@query(f"""WITH {FUSED} SELECT query_id, doc_id, round(rrf, 4) AS score, coalesce(hit, 0)::INT AS hit, row_number() OVER (PARTITION BY query_id ORDER BY round(rrf, 9) DESC, coalesce(hit, 0) DESC, arrival)::INT AS rank FROM h QUALIFY rank <= 8""")
def fuse_with_hits(spark: SparkSession, d: str) -> DataFrame:
    """Fusion of all routes: reciprocal ranks, then hits in title and text, then arrival."""
    arrival = F.struct(F.when(F.col("route") == "content", 0).otherwise(1).alias("o"), F.col("rank").alias("r"))
    fused = routes(spark, d).groupBy("query_id", "doc_id").agg(F.sum(1.0 / (60 + F.col("rank"))).alias("rrf"), F.min(arrival).alias("arrival"))
    best = top_k(with_hits(spark, d, fused), 8, ["query_id"], F.desc(F.round("rrf", 9)), F.desc("hit"), "arrival")
    return best.select("query_id", "doc_id", F.round("rrf", 4).alias("score"), "hit", "rank")


#: What the vector route does and whether it may stand in.
MODES = [("off", "off"), ("shadow", "off"), ("shadow", "on"), ("on", "off")]


@query(f"""WITH {ROUTES}, {TASK_KIND}, m(mode, fallback) AS (VALUES {", ".join(f"('{a}', '{b}')" for a, b in MODES)}),
q AS (SELECT DISTINCT query_id FROM routes), d AS (SELECT query_id, mode, fallback, CASE WHEN mode = 'on' THEN 'hybrid' WHEN mode = 'shadow' AND fallback = 'on' AND kind = 'natural' THEN 'guarded_hybrid_fallback' ELSE 'lexical' END AS display FROM q JOIN k ON query_id = task_id, m),
r AS (SELECT d.*, doc_id, sum(1.0::DOUBLE / (60 + rank)) AS s FROM d JOIN routes USING (query_id) WHERE display <> 'lexical' OR route = 'content' GROUP BY ALL)
SELECT query_id, mode, fallback, display, doc_id, row_number() OVER (PARTITION BY query_id, mode, fallback ORDER BY round(s, 9) DESC, doc_id)::INT AS rank FROM r QUALIFY rank <= 8""")
def display_modes(spark: SparkSession, d: str) -> DataFrame:
    """Which routes' rows are shown: the lexical ones, or both fused, by mode, fallback and kind of question."""
    modes = F.explode(F.array(*[F.struct(F.lit(a).alias("mode"), F.lit(b).alias("fallback")) for a, b in MODES])).alias("m")
    asked = task_kinds(spark, d).withColumnRenamed("task_id", "query_id").select("query_id", "kind", modes).select("query_id", "kind", "m.*")
    guarded = (F.col("mode") == "shadow") & (F.col("fallback") == "on") & (F.col("kind") == "natural")
    display = F.when(F.col("mode") == "on", "hybrid").when(guarded, "guarded_hybrid_fallback").otherwise("lexical")
    rows = asked.withColumn("display", display).join(routes(spark, d), "query_id").where("display <> 'lexical' OR route = 'content'")
    by = ["query_id", "mode", "fallback"]
    scored = rows.groupBy(*by, "display", "doc_id").agg(F.round(F.sum(1.0 / (60 + F.col("rank"))), 9).alias("s"))
    return top_k(scored, 8, by, F.desc("s"), "doc_id").select(*by, "display", "doc_id", "rank")


@query(f"""WITH {ROUTES}, w AS (SELECT item_id AS query_id, {MTOK.format(c="text")} AS t FROM benchmark),
i AS (SELECT query_id, list_filter(t, lambda x: length(x) >= 12) AS ids FROM w),
top AS (SELECT query_id, string_agg(lower(text), chr(10)) AS body FROM routes JOIN documents USING (doc_id) WHERE route = 'content' AND rank <= 5 GROUP BY 1)
SELECT query_id, len(ids)::INT AS identifiers, len(list_filter(ids, lambda x: NOT contains(coalesce(body, ''), x)))::INT AS missing,
(len(ids) > 0 AND len(list_filter(ids, lambda x: contains(coalesce(body, ''), x))) = 0) AS skip_lexical FROM i LEFT JOIN top USING (query_id)""")
def route_collection(spark: SparkSession, d: str) -> DataFrame:
    """The routes' collection: a list that holds none of the question's rare words is skipped."""
    ids = F.filter(T.metric_tokens(F.col("text")), lambda x: F.length(x) >= 12)
    asked = table(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), ids.alias("ids"))
    top = routes(spark, d).where("route = 'content' AND rank <= 5").select("query_id", "doc_id").join(table(spark, d, "documents").select("doc_id", "text"), "doc_id")
    seen = top.join(asked, "query_id").select("query_id", F.explode(F.filter("ids", lambda x: F.contains(F.lower("text"), x))).alias("id")).distinct()
    found = seen.groupBy("query_id").agg(F.count("*").cast("int").alias("found"))
    n, got = F.size("ids"), F.coalesce("found", F.lit(0))
    return asked.join(found, "query_id", "left").select("query_id", n.alias("identifiers"), (n - got).alias("missing"), ((n > 0) & (got == 0)).alias("skip_lexical"))


STATUS = "CASE event_type WHEN 'purchase' THEN 'completed' WHEN 'error' THEN 'failed' ELSE 'accepted' END"


@query(f"""WITH a AS (SELECT user_id, event_type AS stage, count(*) AS attempts, min((ts, event_id)) AS began, arg_max({STATUS}, (ts, event_id)) AS status FROM events GROUP BY ALL)
SELECT user_id, stage, row_number() OVER (PARTITION BY user_id ORDER BY began, stage)::INT AS place, attempts, status FROM a""")
def stage_attempts(spark: SparkSession, d: str) -> DataFrame:
    """Each run's stages in the order in which they were first tried, and how they stand."""
    kind = F.col("event_type")
    status = F.when(kind == "purchase", "completed").when(kind == "error", "failed").otherwise("accepted")
    return sessions.stage_attempts(table(spark, d, "events").withColumn("stage", kind), "user_id", "stage", ["ts", "event_id"], status)


@query("""WITH b AS (SELECT date_trunc('day', ts)::DATE AS day, count(*) AS rows_in, arg_max(event_type, (ts, event_id)) AS last_type FROM events GROUP BY 1),
s AS (SELECT *, sum(rows_in) OVER (ORDER BY day) AS upto FROM b)
SELECT day, rows_in, md5((upto - rows_in)::BIGINT::VARCHAR) AS before_hash, md5(upto::BIGINT::VARCHAR) AS after_hash, CASE WHEN last_type = 'error' THEN 'failed' ELSE 'succeeded' END AS status FROM s""")
def collection_ledger(spark: SparkSession, d: str) -> DataFrame:
    """A row a batch (day): what the store was before and after it, and how it ended. One row a day is ordered."""
    b = table(spark, d, "events").groupBy(F.to_date("ts").alias("day")).agg(F.count("*").alias("rows_in"), F.max_by("event_type", F.struct("ts", "event_id")).alias("last_type"))
    s = b.withColumn("upto", F.sum("rows_in").over(Window.orderBy("day")))
    digest = lambda c: F.md5(c.cast("string"))
    return s.select("day", "rows_in", digest(F.col("upto") - F.col("rows_in")).alias("before_hash"), digest(F.col("upto")).alias("after_hash"), F.when(F.col("last_type") == "error", "failed").otherwise("succeeded").alias("status"))


@query(f"""WITH {CHANGED}, st AS (SELECT doc_id, CASE doc_id % 6 WHEN 0 THEN 'archived' WHEN 1 THEN 'candidate' ELSE 'active' END AS status FROM documents)
SELECT old.doc_id, CASE WHEN new.h IS NULL THEN 'missing' WHEN new.h <> old.h THEN 'stale' WHEN status <> 'active' THEN 'status:' || status ELSE 'read' END AS outcome FROM old LEFT JOIN new USING (doc_id) JOIN st ON st.doc_id = old.doc_id""")
def stale_index_guard(spark: SparkSession, d: str) -> DataFrame:
    """Rows of an index against their sources as they are now: gone, changed, no longer active, or readable."""
    old, new = snapshots(spark, d)
    rest = F.col("doc_id") % 6
    status = F.when(rest == 0, "archived").when(rest == 1, "candidate").otherwise("active")
    now = new.select("doc_id", F.col("h").alias("now"))
    outcome = F.when(F.col("now").isNull(), "missing").when(F.col("now") != F.col("h"), "stale").when(status != "active", F.concat(F.lit("status:"), status)).otherwise("read")
    return old.join(now, "doc_id", "left").select("doc_id", outcome.alias("outcome"))


@query("""SELECT o_orderkey FROM orders WHERE contains(lower(o_orderpriority || ' ' || o_orderstatus), 'h') AND o_orderstatus = 'O' AND o_custkey % 4 = 1 AND (o_custkey % 3 = 0 OR o_custkey % 3 = 1)""")
def five_way_filter(spark: SparkSession, d: str) -> DataFrame:
    """Text, status, source and category, or none of a category, all at once."""
    text = F.lower(F.concat_ws(" ", "o_orderpriority", "o_orderstatus"))
    category = F.when(F.col("o_custkey") % 3 == 0, None).otherwise((F.col("o_custkey") % 3).cast("string"))
    wanted = F.contains(text, F.lit("h")) & (F.col("o_orderstatus") == "O") & (F.col("o_custkey") % 4 == 1) & (category.isNull() | (category == "1"))
    return table(spark, d, "orders").where(wanted).select("o_orderkey")


@query("""WITH k AS (SELECT event_id, json_keys(props::JSON) AS keys, trim(event_type) AS name FROM events)
SELECT event_id, concat_ws('|', CASE WHEN len(list_filter(keys, lambda x: x NOT IN ('k', 'v'))) > 0 THEN 'unknown_field' END, CASE WHEN NOT list_contains(keys, 'k') THEN 'missing_k' END,
CASE WHEN length(name) = 0 THEN 'empty_name' WHEN length(name) > 6 THEN 'name_too_long' END) AS problems FROM k""")
def contract_validation(spark: SparkSession, d: str) -> DataFrame:
    """Records whose fields are unknown, missing, empty or too long."""
    keys = F.json_object_keys("props")
    name = F.trim("event_type")
    problems = F.array(
        F.when(F.size(F.array_except(keys, F.array(F.lit("k"), F.lit("v")))) > 0, "unknown_field"), F.when(~F.array_contains(keys, "k"), "missing_k"),
        F.when(F.length(name) == 0, "empty_name").when(F.length(name) > 6, "name_too_long"),
    )
    return table(spark, d, "events").select("event_id", F.array_join(F.array_compact(problems), "|").alias("problems"))


REFS = """e AS (SELECT doc_id, source || '/' || doc_id || '.md#a:ch00000001' AS actual, CASE doc_id % 6 WHEN 0 THEN source || '/' || doc_id || '.md' WHEN 1 THEN source || '/' || doc_id || '.md#a'
 WHEN 2 THEN doc_id::VARCHAR WHEN 3 THEN 'other/' || doc_id || '.md' WHEN 4 THEN doc_id || '.MD#b' ELSE '' END AS expected FROM documents),
s AS (SELECT *, split_part(split_part(expected, '#', 1), ':ch', 1) AS ee, split_part(split_part(actual, '#', 1), ':ch', 1) AS ae FROM e)"""


@query(rf"""WITH {REFS} SELECT doc_id, expected <> '' AND (expected = actual OR starts_with(actual, expected || ':ch') OR starts_with(actual, expected || '#') OR starts_with(expected, actual || '#') OR starts_with(expected, actual || ':ch')
 OR ((NOT contains(ee, '/') OR NOT contains(ae, '/')) AND regexp_replace(list_last(string_split(ee, '/')), '(?i)\.md$', '') = regexp_replace(list_last(string_split(ae, '/')), '(?i)\.md$', ''))) AS same FROM s""")
def citation_matches(spark: SparkSession, d: str) -> DataFrame:
    """Whether a citation, as people write them, names the document that was retrieved."""
    n, path = F.col("doc_id"), F.concat("source", F.lit("/"), "doc_id", F.lit(".md"))
    rest = n % 6
    expected = (
        F.when(rest == 0, path).when(rest == 1, F.concat(path, F.lit("#a"))).when(rest == 2, n.cast("string"))
        .when(rest == 3, F.concat(F.lit("other/"), n, F.lit(".md"))).when(rest == 4, F.concat(n, F.lit(".MD#b"))).otherwise("")
    )
    return table(spark, d, "documents").select("doc_id", Q.same_reference(expected, F.concat(path, F.lit("#a:ch00000001"))).alias("same"))


@query(f"""WITH {EDGE}, x AS (SELECT count(*) FILTER (NOT ok) AS dead FROM (SELECT DISTINCT src, link, ok FROM r)), y AS (SELECT count(*) AS orphans FROM n WHERE path NOT IN (SELECT dst FROM r WHERE ok)),
z AS (SELECT count(*) FILTER (NOT contains(html, '<html lang=')) AS bare FROM pages) SELECT dead, orphans, bare, greatest(0, round(100 - dead - orphans * 0.5 - bare * 0.1))::BIGINT AS score FROM x, y, z""")
def vault_health(spark: SparkSession, d: str) -> DataFrame:
    """Dead links, notes that none refers to and notes without properties, as one mark of 100."""
    nodes, links = edges(spark, d)
    dead = links.where("dst IS NULL").select("src", "link").distinct().agg(F.count("*").alias("dead"))
    orphans = nodes.join(links.where("dst IS NOT NULL").select(F.col("dst").alias("node")), "node", "left_anti").agg(F.count("*").alias("orphans"))
    bare = table(spark, d, "pages").agg(F.count_if(~F.contains("html", F.lit("<html lang="))).alias("bare"))
    row = dead.join(F.broadcast(orphans)).join(F.broadcast(bare))
    return row.withColumn("score", F.greatest(F.lit(0), F.round(100 - F.col("dead") - F.col("orphans") * 0.5 - F.col("bare") * 0.1)).cast("long"))


@query(f"""WITH t AS (SELECT conv_id * 1000 + turn AS id, {MTOK.format(c="coalesce(text, '')")} AS w FROM conversations), s AS (SELECT id, w, len(w) AS n FROM t WHERE len(w) > 0),
p AS (SELECT a.id, b.id AS other, round(len(list_intersect(a.w, b.w)) / a.n, 6) AS coverage FROM s a JOIN s b ON a.id <> b.id AND b.n >= 0.72 * a.n)
SELECT id, other, coverage FROM p WHERE coverage >= 0.72 QUALIFY row_number() OVER (PARTITION BY id ORDER BY coverage DESC, other) = 1""")
def covered_records(spark: SparkSession, d: str) -> DataFrame:
    """Each record of whose words another one holds at least 0.72, with the best of these."""
    key = F.col("conv_id") * 1000 + F.col("turn")
    sets = table(spark, d, "conversations").select(key.alias("id"), T.metric_tokens(F.col("text")).alias("tokens"))
    return best_coverage(sets, 0.72)


@query("""WITH f AS (SELECT doc_id, lang, len(string_split(text, chr(10)))::BIGINT AS size FROM documents), 
q AS (SELECT m.doc_id AS doc_id, lang, m.size AS size FROM (SELECT lang, min(struct_pack(size := size, doc_id := doc_id)) AS m FROM f GROUP BY 1)),
u AS (SELECT *, sum(size) OVER (ORDER BY lang) AS used FROM q), k AS (SELECT doc_id, lang, size FROM u WHERE used <= 500),
r AS (SELECT f.*, sum(size) OVER (ORDER BY size, doc_id) AS used FROM f WHERE doc_id NOT IN (SELECT doc_id FROM k))
SELECT doc_id, lang, size FROM k UNION ALL SELECT doc_id, lang, size FROM r WHERE used <= 500 - (SELECT coalesce(sum(size), 0) FROM k)""")
def stratified_sample(spark: SparkSession, d: str) -> DataFrame:
    """Whole documents within 500 lines: the shortest of each language, then others by length."""
    files = table(spark, d, "documents").select("doc_id", "lang", F.size(F.split("text", "\n", -1)).cast("long").alias("size"))
    return sessions.whole_sample(files, "lang", "size", "doc_id", 500)


@query(f"""WITH {RECORDS}, r AS (SELECT project_id AS kind, status <> 'active' OR TIMESTAMP '1996-06-01 00:00:00' < valid_from AS hidden, importance > 5 AS expected FROM rec)
SELECT kind, count(*) AS cases, count(*) FILTER (hidden = expected) AS passed, round(count(*) FILTER (hidden = expected) / count(*), 4) AS pass_rate FROM r GROUP BY 1""")
def governance_pass_rates(spark: SparkSession, d: str) -> DataFrame:
    """How many cases of each kind came out as expected."""
    hidden = (F.col("status") != "active") | (F.lit("1996-06-01").cast("timestamp_ntz") < F.col("valid_from"))
    passed = F.count_if(hidden == (F.col("importance") > 5))
    return records(spark, d).groupBy(F.col("project_id").alias("kind")).agg(F.count("*").alias("cases"), passed.alias("passed"), F.round(passed / F.count("*"), 4).alias("pass_rate"))


GATE_SQL = f"""{JUDGED}, {CHANGED}, rr AS (SELECT query_id AS task_id, doc_id AS ref, row_number() OVER (PARTITION BY query_id ORDER BY round(sum(1.0::DOUBLE / (60 + rank)), 9) DESC, doc_id) AS rank FROM routes GROUP BY query_id, doc_id),
g5 AS (SELECT q.task_id, count(rr.ref) / count(*) AS recall FROM qrels q LEFT JOIN rr ON rr.task_id = q.task_id AND rr.ref = q.ref AND rr.rank <= 5 GROUP BY 1),
v5 AS (SELECT x.vec_id, max((y.vec_id = x.vec_id)::INT) FILTER (place <= 5) AS recall FROM (SELECT x.vec_id, y.vec_id AS other, row_number() OVER (PARTITION BY x.vec_id ORDER BY round(list_cosine_similarity(x.embedding::DOUBLE[], y.embedding::DOUBLE[]), 6) DESC, y.vec_id) AS place
 FROM embeddings x, embeddings y WHERE x.vec_id % 100 = 0 AND x.vec_id IN (SELECT doc_id FROM documents) AND y.vec_id IN (SELECT doc_id FROM documents)) x JOIN (SELECT vec_id FROM embeddings) y ON y.vec_id = other GROUP BY 1),
neg AS (SELECT avg((task_id NOT IN (SELECT query_id FROM a WHERE rank <= 5))::INT) AS lexical_clean, avg((task_id NOT IN (SELECT task_id FROM rr WHERE rank <= 5))::INT) AS rrf_clean FROM (SELECT item_id AS task_id FROM benchmark WHERE item_id NOT IN (SELECT task_id FROM qrels))),
lat AS (SELECT v[floor(0.95 * (len(v) - 1))::INT + 1] AS p95 FROM (SELECT list_sort(list(value)) AS v FROM events WHERE event_type = 'view')),
cov AS (SELECT round(count(*) FILTER (new.h = old.h) / count(*), 3) AS coverage FROM new LEFT JOIN old USING (doc_id)),
fail AS (SELECT count(*) FILTER (last_type = 'error') AS failures FROM (SELECT arg_max(event_type, (ts, event_id)) AS last_type FROM events GROUP BY user_id)),
top AS (SELECT count(*) FILTER (ref % 11 = 0) AS outside, count(*) FILTER (ref IN (SELECT doc_id FROM labels WHERE toxic = 1)) AS bad_answers FROM rr WHERE rank = 1),
l5 AS (SELECT q.task_id, count(a.doc_id) / count(*) AS recall FROM qrels q LEFT JOIN a ON a.query_id = q.task_id AND a.doc_id = q.ref AND a.rank <= 5 GROUP BY 1),
ans AS (SELECT count(*) AS cases, count(*) FILTER (o_orderkey % 3 <> 0 AND o_totalprice <= 150000) / count(*) FILTER (o_totalprice <= 150000) AS false_answer, count(*) FILTER (o_orderkey % 3 = 0 AND o_totalprice > 150000) / count(*) FILTER (o_totalprice > 150000) AS false_refusal FROM orders),
fig AS (SELECT (SELECT round(avg(recall), 6) FROM l5) AS lexical_recall, (SELECT round(avg(recall), 6) FROM g5) AS rrf_recall, (SELECT count(*) FROM rr JOIN labels ON ref = doc_id WHERE rank <= 5 AND toxic = 1) AS forbidden, cases, round(false_answer, 6) AS false_answer, round(false_refusal, 6) AS false_refusal,
 (SELECT round(avg(recall), 6) FROM v5) AS vector_recall, round(lexical_clean, 6) AS lexical_clean, round(rrf_clean, 6) AS rrf_clean, p95, coverage, failures, outside, bad_answers FROM ans, neg, lat, cov, fail, top)"""
GATE_CHECKS = [
    ("rrf_recall_at_5", "rrf_recall >= lexical_recall"), ("lexical_available", "lexical_recall IS NOT NULL"), ("rrf_available", "rrf_recall IS NOT NULL"),
    ("forbidden_zero", "forbidden = 0"), ("answer_gate_available", "cases > 0"), ("answer_gate_real_cases", "cases >= 20"), ("answer_false_rate", "false_answer <= 0.05"), ("answer_false_refusal_rate", "false_refusal <= 0.2"),
    ("vector_available", "vector_recall IS NOT NULL"), ("rrf_p95", "p95 < 500"), ("negative_clean_at_5", "rrf_clean >= lexical_clean"), ("index_failures_zero", "failures = 0"), ("index_coverage", "coverage >= 1"),
    ("answer_citation_out_of_scope_zero", "outside = 0"), ("answer_forbidden_zero", "bad_answers = 0"),
]


@query(f"WITH {GATE_SQL} " + " UNION ALL ".join(f"SELECT '{n}' AS check_name, coalesce({c}, false) AS passed FROM fig" for n, c in GATE_CHECKS))
def release_gate(spark: SparkSession, d: str) -> DataFrame:
    """The fifteen checks of a release over retrieval, the index, forbidden rows and answers."""
    found = routes(spark, d)
    score = F.round(F.sum(1.0 / (60 + F.col("rank"))), 9)
    fused = top_k(found.groupBy("query_id", "doc_id").agg(score.alias("s")), 5, ["query_id"], F.desc("s"), "doc_id").select(F.col("query_id").alias("task_id"), F.col("doc_id").alias("ref"), "rank")
    first5 = lambda route: found.where((F.col("route") == route) & (F.col("rank") <= 5)).select(F.col("query_id").alias("task_id"), F.col("doc_id").alias("ref"))
    lexical = first5("content")
    good = qrels(spark, d).select("task_id", "ref")

    def recall(hits: DataFrame, name: str) -> DataFrame:
        share = good.join(hits.withColumn("hit", F.lit(1)), ["task_id", "ref"], "left").groupBy("task_id").agg((F.count("hit") / F.count("*")).alias("r"))
        return share.agg(F.round(F.avg("r"), 6).alias(name))

    toxic = table(spark, d, "labels").where("toxic = 1").select(F.col("doc_id").alias("ref"), F.lit(True).alias("toxic"))
    shown = fused.join(toxic, "ref", "left")
    is_first = F.col("rank") == 1
    bad = shown.agg(F.count_if("toxic").alias("forbidden"), F.count_if(is_first & F.col("toxic")).alias("bad_answers"), F.count_if(is_first & (F.col("ref") % 11 == 0)).alias("outside"))
    negatives = table(spark, d, "benchmark").select(F.col("item_id").alias("task_id")).join(good.select("task_id").distinct(), "task_id", "left_anti")

    def clean(hits: DataFrame, name: str) -> DataFrame:
        some = negatives.join(hits.select("task_id").distinct().withColumn("some", F.lit(1)), "task_id", "left")
        return some.agg(F.round(F.avg(F.when(F.col("some").isNull(), 1.0).otherwise(0.0)), 6).alias(name))

    events = table(spark, d, "events")
    p95 = E.percentile_at(0.95, "value", ["event_type"], events.where("event_type = 'view'")).agg(F.max("value").alias("p95"))
    failures = events.groupBy("user_id").agg(F.max_by("event_type", F.struct("ts", "event_id")).alias("last")).agg(F.count_if(F.col("last") == "error").alias("failures"))
    old, new = snapshots(spark, d)
    held = new.join(old.withColumnRenamed("h", "old_h"), "doc_id", "left").agg(F.round(F.count_if(F.col("h") == F.col("old_h")) / F.count("*"), 3).alias("coverage"))
    answers = E.answer_figures(table(spark, d, "orders").select((F.col("o_totalprice") > 150000).alias("answerable"), (F.col("o_orderkey") % 3 != 0).alias("answered")))
    figures = answers
    shares = recall(lexical, "lexical_recall"), recall(fused, "rrf_recall"), own_vector_recall(spark, d), clean(lexical, "lexical_clean"), clean(fused, "rrf_clean")
    for one in (*shares, bad, p95, failures, held):
        figures = figures.join(F.broadcast(one))
    return E.gate(figures, dict(GATE_CHECKS))


def own_vector_recall(spark: SparkSession, d: str) -> DataFrame:
    """The share of questions with a vector whose own document is among the five nearest; null without any vector."""
    asked = questions(spark, d).where("unit IS NOT NULL").select("query_id", "unit")
    near = cosine_topk(asked, corpus_vectors(spark, d), 5).where("query_id = vec_id").select("query_id", F.lit(1).alias("hit"))
    return asked.join(near, "query_id", "left").agg(F.round(F.avg(F.coalesce("hit", F.lit(0))), 6).alias("vector_recall"))


THREE = r"array_to_string(string_split(regexp_replace(trim(text), '\s+', ' ', 'g'), ' ')[1:3], ' ')"


@query(rf"""WITH {FIELDS}, q AS (SELECT doc_id AS query_id, unnest({TOKENS_SQL.format(c=THREE)}) AS token FROM documents WHERE doc_id % 100 = 0), n AS (SELECT count(*) AS n FROM documents),
df AS (SELECT token, count(*) AS df FROM posting WHERE token IN (SELECT token FROM q) GROUP BY 1),
w AS (SELECT query_id, token, ln((n + 1) / (coalesce(df, 0) + 1)) + 1 AS idf, length(token) >= 3 AND strlen(token) = length(token) AS ident FROM q LEFT JOIN df USING (token), n),
h AS (SELECT query_id, doc_id, token, weight, fields, idf, ident FROM posting JOIN w USING (token)),
b AS (SELECT query_id, doc_id, sum(weight) AS score FROM h GROUP BY query_id, doc_id QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY sum(weight) DESC, doc_id) <= 50),
i AS (SELECT query_id, doc_id, sum(weight) AS rare_score, bool_or(contains(fields, 'title')) AS titled FROM h WHERE ident AND idf >= 2.5 GROUP BY query_id, doc_id QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY sum(weight) DESC, doc_id) <= 50),
m AS (SELECT query_id, doc_id, score, rare_score FROM b FULL JOIN (SELECT * FROM i WHERE titled) USING (query_id, doc_id)),
o AS (SELECT query_id, doc_id, sum(idf) AS matched, count(*) FILTER (ident) AS hit FROM h GROUP BY ALL), a AS (SELECT query_id, sum(idf) AS total, count(*) FILTER (ident) AS ids, count(*) FILTER (ident AND idf >= 2.5) AS rares FROM w GROUP BY 1),
r AS (SELECT query_id, doc_id, coalesce(rare_score, score) AS score, (rare_score IS NOT NULL AND ids = 1)::INT AS in_title, round(matched / total, 9) AS coverage, round(matched, 9) AS matched, (ids > 0 AND hit = ids)::INT AS every,
 bool_or(rare_score IS NOT NULL) OVER (PARTITION BY query_id) AND rares = 1 AS rescued FROM m JOIN o USING (query_id, doc_id) JOIN a USING (query_id))
SELECT query_id, doc_id, score, rescued, row_number() OVER (PARTITION BY query_id ORDER BY CASE WHEN rescued THEN in_title ELSE 0 END DESC, score DESC, CASE WHEN rescued THEN coverage ELSE 0 END DESC, CASE WHEN rescued THEN matched ELSE 0 END DESC,
 CASE WHEN rescued THEN every ELSE 0 END DESC, CASE WHEN rescued THEN doc_id ELSE -doc_id END DESC)::INT AS rank FROM r QUALIFY rank <= 8""")
def title_rescue(spark: SparkSession, d: str) -> DataFrame:
    """Every hundredth document asked by its first three words: a rare name in a title comes first."""
    docs = as_notes(spark, d)
    asked = table(spark, d, "documents").where("doc_id % 100 = 0")
    first = F.array_join(F.slice(F.split(F.regexp_replace(F.trim("text"), r"\s+", " "), " "), 1, 3), " ")
    tokens = asked.select(F.col("doc_id").alias("query_id"), F.explode(T.index_tokens(first)).alias("token"))
    titles = docs.select("doc_id", hashed(T.index_tokens(F.col("title"))).alias("title"))
    return rescued_topk(document_terms(docs, FIELD_WEIGHTS), titles, tokens, docs.agg(F.count("*").alias("n")), 8)


@query(r"""WITH c AS (SELECT conv_id AS entry, role AS heading, turn AS place, conv_id || '/' || turn AS ref, coalesce(text, '') AS text FROM conversations),
a AS (SELECT *, lag(ref) OVER w AS r1, lag(text) OVER w AS t1, lead(ref) OVER w AS r2, lead(text) OVER w AS t2, left(text, 300) AS s0 FROM c WINDOW w AS (PARTITION BY entry, heading ORDER BY place)),
b AS (SELECT *, chr(10) || chr(10) || '[context_of:' || r1 || ']' || chr(10) AS m1, chr(10) || chr(10) || '[context_of:' || r2 || ']' || chr(10) AS m2 FROM a),
d AS (SELECT *, coalesce(300 - length(s0) - length(m1) > 0, false) AS f1 FROM b), e AS (SELECT *, CASE WHEN f1 THEN s0 || m1 || left(t1, 300 - length(s0) - length(m1)) ELSE s0 END AS s1,
 r1 IS NOT NULL AND (NOT f1 OR length(t1) > 300 - length(s0) - length(m1)) AS full1 FROM d), g AS (SELECT *, coalesce(NOT full1 AND 300 - length(s1) - length(m2) > 0, false) AS f2 FROM e)
SELECT entry, heading, place, ref, CASE WHEN f2 THEN s1 || m2 || left(t2, 300 - length(s1) - length(m2)) ELSE s1 END AS content, concat_ws('|', CASE WHEN f1 THEN r1 END, CASE WHEN f2 THEN r2 END) AS context_of FROM g""")
def context_expansion(spark: SparkSession, d: str) -> DataFrame:
    """Each turn with its neighbours of the same role in 300 characters, marked with where they stand."""
    ref = F.concat(F.col("conv_id"), F.lit("/"), F.col("turn"))
    chunks = table(spark, d, "conversations").select(F.col("conv_id").alias("entry"), F.col("role").alias("heading"), F.col("turn").alias("place"), ref.alias("ref"), F.coalesce("text", F.lit("")).alias("text"))
    return expanded_context(chunks, 1, 300)
