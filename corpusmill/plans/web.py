"""Pages, URLs, links, redaction, JSON and corpus profiles."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusmill.functions import text as T
from corpusmill.functions import web as W
from corpusmill.operators import graph
from corpusmill.operators.lexical import top_k
from corpusmill.plans.registry import query
from corpusmill.sources.notes import feed_items
from corpusmill.sources.tables import table

PLAIN = "html"
for _p in (r"(?is)<script\b.*?</script>", r"(?is)<style\b.*?</style>", r"(?s)<!--.*?-->", r"(?s)<[^>]*>"):
    PLAIN = f"regexp_replace({PLAIN}, '{_p}', ' ', 'g')"
for _n, _c in W.ENTITIES:
    PLAIN = f"replace({PLAIN}, '{_n}', '{_c.replace(chr(39), chr(39) * 2)}')"
PLAIN = rf"trim(regexp_replace({PLAIN}, '[ \t\n\x0b\f\r]+', ' ', 'g'))"
HOST = r"regexp_replace(lower(regexp_extract(url, '^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#]*)', 1)), '^(www|m)\.', '')"
PATH = "regexp_extract(url, '^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*([^?#]*)', 1)"
CANON = f"{HOST} || regexp_replace(lower({PATH}), '/+$', '')"


@query(f"SELECT page_id, {PLAIN} AS text FROM pages")
def html_to_text(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "pages").select("page_id", W.strip_html(F.col("html")).alias("text"))


@query(r"""SELECT page_id, regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1) AS title, regexp_extract(html, '(?is)<h1[^>]*>(.*?)</h1>', 1) AS heading,
regexp_extract(html, '<html lang="([a-z]+)"', 1) AS lang, len(regexp_extract_all(html, '(?i)<p\b')) AS paragraphs FROM pages""")
def article_fields(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "pages").select(
        "page_id",
        F.regexp_extract("html", r"(?is)<title[^>]*>(.*?)</title>", 1).alias("title"),
        F.regexp_extract("html", r"(?is)<h1[^>]*>(.*?)</h1>", 1).alias("heading"),
        F.regexp_extract("html", r'<html lang="([a-z]+)"', 1).alias("lang"),
        F.size(F.regexp_extract_all("html", F.lit(r"(?i)<p\b"), 0)).cast("long").alias("paragraphs"),
    )


@query(f"SELECT page_id, {CANON} AS fingerprint FROM pages")
def url_canonical(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "pages").select("page_id", W.canonical_url(F.col("url")).alias("fingerprint"))


@query(f"SELECT {CANON} AS fingerprint, min(page_id) AS page_id, count(*) AS copies FROM pages GROUP BY 1")
def url_dedupe(spark: SparkSession, d: str) -> DataFrame:
    """The first page of each fingerprint stays."""
    return table(spark, d, "pages").groupBy(W.canonical_url(F.col("url")).alias("fingerprint")).agg(F.min("page_id").alias("page_id"), F.count("*").alias("copies"))


@query(f"""SELECT page_id, ({HOST} = 'example.com' OR ends_with({HOST}, '.example.com') OR {HOST} = 'example.org' OR ends_with({HOST}, '.example.org')) AS listed FROM pages""")
def whitelist_host(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "pages").select("page_id", W.host_within(W.url_host(F.col("url")), ["example.com", "example.org"]).alias("listed"))


@query(f"""SELECT page_id, {PATH} AS path FROM pages WHERE regexp_matches({PATH}, '/en/.*') AND NOT regexp_matches({PATH}, '/en/[^/]*.html')""")
def glob_blacklist(spark: SparkSession, d: str) -> DataFrame:
    paths = table(spark, d, "pages").select("page_id", W.url_path(F.col("url")).alias("path"))
    return paths.where(F.col("path").rlike(W.glob_pattern("/en/**")) & ~F.col("path").rlike(W.glob_pattern("/en/*.html")))


@query(f"""SELECT page_id, {PATH} AS path FROM pages WHERE NOT regexp_matches({PATH}, '/de/.*') AND NOT regexp_matches({PATH}, '/fr/[^/]*') AND NOT regexp_matches({PATH}, '/en/1[^/]*(?:/|$)|/en/2(?:/|$)')""")
def boundary_blacklist(spark: SparkSession, d: str) -> DataFrame:
    """Paths that no pattern with bounds holds for."""
    paths = table(spark, d, "pages").select("page_id", W.url_path(F.col("url")).alias("path"))
    for glob in ("/de/", "/fr/*", "/en/2"):
        paths = paths.where(~F.col("path").rlike(W.boundary_pattern(glob)))
    return paths.where(~F.col("path").rlike(W.glob_pattern("/en/1*") + "(?:/|$)"))


@query("""SELECT doc_id, source || '/' || doc_id || '.md' AS path FROM documents WHERE starts_with(source || '/', 'src1/') OR starts_with(source || '/', 'src2/')""")
def prefix_scope_filter(spark: SparkSession, d: str) -> DataFrame:
    paths = table(spark, d, "documents").select("doc_id", F.concat("source", F.lit("/"), "doc_id", F.lit(".md")).alias("path"))
    return paths.where(F.startswith("path", F.lit("src1/")) | F.startswith("path", F.lit("src2/")))


LINKS = """l AS (SELECT page_id, unnest(regexp_extract_all(html, 'href="([^"]*)"', 1)) AS href FROM pages)"""


@query(f"WITH {LINKS} SELECT page_id, href, count(*) AS n FROM l GROUP BY ALL")
def link_graph(spark: SparkSession, d: str) -> DataFrame:
    edges = table(spark, d, "pages").select("page_id", F.explode(W.links(F.col("html"))).alias("href"))
    return edges.groupBy("page_id", "href").agg(F.count("*").alias("n"))


EDGE = r"""n AS (SELECT page_id || '/' || lower(regexp_extract(html, '<h1>([^ <.,]*)', 1)) || '.md' AS path FROM pages),
h AS (SELECT page_id || '/' || lower(regexp_extract(html, '<h1>([^ <.,]*)', 1)) || '.md' AS src, unnest(regexp_extract_all(html, 'href="([^"]*)"', 1)) AS link FROM pages),
b AS (SELECT regexp_replace(split_part(path, '/', 2), '\.md$', '') AS base, min(path) AS dst FROM n GROUP BY 1),
r AS (SELECT src, link, dst, dst IS NOT NULL AS ok FROM (SELECT *, regexp_replace(list_last(string_split(regexp_replace(lower(trim(link)), '^[./]+', ''), '/')), '\.md$', '') AS base FROM h) LEFT JOIN b USING (base))"""


def edges(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges): pages as notes named by the first word of their heading, and their hrefs,
    resolved by name as links between notes are; many lead nowhere."""
    pages = table(spark, d, "pages")
    path = F.concat(F.col("page_id"), F.lit("/"), F.lower(F.regexp_extract("html", r"<h1>([^ <.,]*)", 1)), F.lit(".md"))
    notes = pages.select(path.alias("path"))
    raw = pages.select(path.alias("src"), F.explode(W.links(F.col("html"))).alias("link"))
    return notes.select(F.col("path").alias("node")), graph.resolve_links(raw, notes)


@query(f"WITH {EDGE} SELECT src, link, count(*) AS n FROM r WHERE NOT ok GROUP BY ALL")
def dead_links(spark: SparkSession, d: str) -> DataFrame:
    return edges(spark, d)[1].where("dst IS NULL").groupBy("src", "link").agg(F.count("*").alias("n"))


DEGREE = f"""{EDGE}, o AS (SELECT src AS node, count(*) AS outbound FROM r GROUP BY 1), i AS (SELECT dst AS node, count(DISTINCT src) AS inbound FROM r WHERE ok AND src <> dst GROUP BY 1),
g AS (SELECT path AS node, coalesce(outbound, 0) AS outbound, coalesce(inbound, 0) AS inbound FROM n LEFT JOIN o ON path = o.node LEFT JOIN i ON path = i.node)"""


@query(f"WITH {DEGREE} SELECT * FROM g WHERE inbound = 0")
def unlinked_notes(spark: SparkSession, d: str) -> DataFrame:
    return graph.degrees(*edges(spark, d)).where("inbound = 0")


@query(f"""WITH {DEGREE}, s AS (SELECT count(*) AS nodes, count(*) FILTER (outbound = 0 AND inbound = 0) AS orphans, count(*) FILTER (inbound = 0) AS unlinked FROM g),
t AS (SELECT count(*) AS links, count(*) FILTER (NOT ok) AS broken FROM r) SELECT *, round(1 - broken / greatest(1, links), 3) AS score FROM s, t""")
def health_score(spark: SparkSession, d: str) -> DataFrame:
    return graph.health(*edges(spark, d))


@query(f"""WITH {EDGE}, s AS (SELECT DISTINCT src, dst FROM r WHERE ok), one AS (SELECT src AS node, dst AS other, 1 AS hops FROM s),
two AS (SELECT node, s.dst AS other, 2 AS hops FROM one JOIN s ON other = s.src) SELECT node, other, min(hops) AS hops FROM (SELECT * FROM one UNION ALL SELECT * FROM two) WHERE node <> other GROUP BY ALL""")
def graph_two_hop(spark: SparkSession, d: str) -> DataFrame:
    """What every page reaches in one or two links."""
    nodes, links = edges(spark, d)
    return graph.two_hops(links, nodes)


NUMBERED = """e AS (SELECT page_id AS src, CASE WHEN page_id % 3 = 0 THEN (page_id * 7 + k) % n ELSE (page_id + k * k) % n END AS dst FROM pages, (VALUES (1), (2), (5)) v(k), (SELECT greatest(max(page_id) + 1, 1) AS n FROM pages) WHERE page_id % 4 <> 1),
s AS (SELECT DISTINCT src, dst FROM e WHERE dst IN (SELECT page_id FROM pages))"""


@query(f"""WITH {NUMBERED}, one AS (SELECT src AS node, dst AS other, 1 AS hops FROM s), two AS (SELECT node, s.dst AS other, 2 AS hops FROM one JOIN s ON other = s.src)
SELECT node, other, min(hops) AS hops FROM (SELECT * FROM one UNION ALL SELECT * FROM two) WHERE node <> other GROUP BY ALL""")
def graph_two_hop_all(spark: SparkSession, d: str) -> DataFrame:
    """Two hops over links between page numbers, a denser graph than the hrefs give."""
    pages = table(spark, d, "pages").select("page_id")
    src = F.col("src")
    out = pages.where("page_id % 4 <> 1").select(F.col("page_id").alias("src"), F.explode(F.array(F.lit(1), F.lit(2), F.lit(5))).alias("k"))
    out = out.join(F.broadcast(pages.agg(F.greatest(F.max("page_id") + 1, F.lit(1)).alias("n"))))
    raw = out.select("src", F.when(src % 3 == 0, (src * 7 + F.col("k")) % F.col("n")).otherwise((src + F.col("k") * F.col("k")) % F.col("n")).alias("dst"))
    links = raw.join(pages.select(F.col("page_id").alias("dst")), "dst", "left_semi")
    return graph.two_hops(links, pages.select(F.col("page_id").alias("node")))


@query(f"""WITH {EDGE}, s AS (SELECT DISTINCT src, dst FROM r WHERE ok AND src <> dst), nn AS (SELECT DISTINCT src AS node FROM r UNION SELECT DISTINCT dst FROM r WHERE ok),
i AS (SELECT dst AS node, 'in' AS way, src AS other, 1 AS hops, row_number() OVER (PARTITION BY dst ORDER BY src)::INT AS rank FROM s QUALIFY rank <= 30),
t AS (SELECT node, other, min(hops) AS hops FROM (SELECT src AS node, dst AS other, 1 AS hops FROM s UNION ALL SELECT a.src, b.dst, 2 FROM s a JOIN s b ON a.dst = b.src) WHERE node <> other GROUP BY ALL),
o AS (SELECT node, 'out' AS way, other, hops, row_number() OVER (PARTITION BY node ORDER BY hops, other)::INT AS rank FROM t QUALIFY rank <= 50) SELECT * FROM i UNION ALL SELECT * FROM o""")
def graph_neighbourhood(spark: SparkSession, d: str) -> DataFrame:
    """Around every page: the first thirty that link to it, the first fifty that it reaches in two links."""
    nodes, links = edges(spark, d)
    return graph.neighbourhood(links, nodes)


SECRET_SQL = "text"
for _p, _r in T.SECRETS:
    SECRET_SQL = "regexp_replace({}, '{}', '{}', 'g')".format(SECRET_SQL, _p.replace("'", "''"), _r.replace("$1", chr(92) + "1"))


@query(f"SELECT doc_id, {SECRET_SQL} AS text FROM documents")
def redact_secrets(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", T.redact(F.col("text")).alias("text"))


@query("SELECT event_type, (props::JSON->>'k')::INT AS k, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def props_json(spark: SparkSession, d: str) -> DataFrame:
    k = F.from_json("props", "k int")["k"]
    return table(spark, d, "events").groupBy("event_type", k.alias("k")).agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))


@query("""SELECT event_id, (regexp_extract('note: [' || props || ', {"k": 7}] end', '\\[.*\\]', 0)::JSON->>'$[0].k')::INT AS first_k, json_array_length(regexp_extract('note: [' || props || ', {"k": 7}] end', '\\[.*\\]', 0))::INT AS n FROM events""".replace("\\\\", "\\"))
def tolerant_json_array(spark: SparkSession, d: str) -> DataFrame:
    """The array between the first ``[`` and the last ``]`` of a text."""
    text = F.concat(F.lit("note: ["), "props", F.lit(', {"k": 7}] end'))
    parsed = F.from_json(F.regexp_extract(text, r"\[.*\]", 0), "array<struct<k:int>>")
    return table(spark, d, "events").select("event_id", parsed[0]["k"].alias("first_k"), F.size(parsed).alias("n"))


@query("""SELECT event_id, CASE WHEN event_id % 5 = 4 THEN NULL ELSE (props::JSON->>'k')::INT END AS k, event_id % 5 <> 4 AS found FROM events""")
def balanced_json_objects(spark: SparkSession, d: str) -> DataFrame:
    """The object within an answer: fenced, among words, with brackets in its strings, before another, or never closed."""
    n, props = F.col("event_id"), F.col("props")
    nested = F.concat(F.lit('{"note": "a } and \\" b {", "in": ['), props, F.lit('], "k": '), F.get_json_object(props, "$.k"), F.lit("}"))
    text = F.when(n % 5 == 0, F.concat(F.lit("```json\n"), props, F.lit("\n```"))).when(n % 5 == 1, F.concat(F.lit("it says "), props, F.lit(" as asked}")))
    text = text.when(n % 5 == 2, F.concat(F.lit("see "), nested, F.lit(" [end"))).when(n % 5 == 3, F.concat(props, F.lit(' {"k": -1}'))).otherwise(F.concat(F.lit("cut {"), props))
    found = T.balanced_json(text)
    return table(spark, d, "events").select("event_id", F.get_json_object(found, "$.k").cast("int").alias("k"), found.isNotNull().alias("found"))


@query("""SELECT 'feed' || (page_id // 20) AS url, 'Page ' || page_id || ' & more' AS title, url AS link, 'about ' || page_id AS text FROM pages WHERE trim(url) <> ''""")
def feed_entries(spark: SparkSession, d: str) -> DataFrame:
    """Twenty pages a feed, RSS and Atom by turns, parsed as XML."""
    safe = lambda c: F.replace(F.replace(F.replace(c, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit('"'), F.lit("&quot;"))
    pages = table(spark, d, "pages").where("trim(url) <> ''")
    n, link = F.col("page_id").cast("string"), safe(F.col("url"))
    rss = F.concat(F.lit("<item><title><![CDATA[Page "), n, F.lit(" & more]]></title><link>"), link, F.lit("</link><description>&lt;p&gt;about "), n, F.lit("&lt;/p&gt;</description></item>"))
    atom = F.concat(F.lit('<entry><title type="text">Page '), n, F.lit(' &amp; more</title><link href="'), link, F.lit('"/><summary>about '), n, F.lit("</summary></entry>"))
    part = F.floor(F.col("page_id") / 20)
    gathered = pages.groupBy(part.alias("part")).agg(F.array_join(F.collect_list(F.when(part % 2 == 0, rss).otherwise(atom)), "").alias("all"))
    xml = F.when(F.col("part") % 2 == 0, F.concat(F.lit("<rss><channel>"), "all", F.lit("</channel></rss>"))).otherwise(F.concat(F.lit('<feed xmlns="http://www.w3.org/2005/Atom">'), "all", F.lit("</feed>")))
    return feed_items(gathered.select(F.concat(F.lit("feed"), "part").alias("url"), xml.alias("xml"))).select("url", "title", "link", "text")


@query("""WITH s AS (SELECT length(text)::BIGINT AS n FROM documents), a AS (SELECT list_sort(list(n)) AS v, count(*) AS c, sum(n)::BIGINT AS chars, max(n) AS longest FROM s)
SELECT c AS notes, chars, longest, v[round_even(0.5 * (c - 1), 0)::INT + 1] AS p50, v[round_even(0.9 * (c - 1), 0)::INT + 1] AS p90, v[round_even(0.99 * (c - 1), 0)::INT + 1] AS p99 FROM a""")
def corpus_inventory(spark: SparkSession, d: str) -> DataFrame:
    """Counts, size and percentiles at the rounded rank; only distinct lengths are gathered."""
    lengths = table(spark, d, "documents").select(F.length("text").cast("long").alias("n"))
    counted = lengths.groupBy("n").agg(F.count("*").alias("c"))
    hist = counted.agg(F.array_sort(F.collect_list(F.struct("n", "c"))).alias("h"), F.sum("c").alias("notes"), F.sum(F.col("n") * F.col("c")).alias("chars"), F.max("n").alias("longest"))

    def at(p: float):
        rank = F.rint(F.lit(p) * (F.col("notes") - 1))
        start = F.struct(F.lit(0).cast("long").alias("seen"), F.lit(None).cast("long").alias("v"))
        step = lambda s, x: F.struct((s["seen"] + x["c"]).alias("seen"), F.coalesce(s["v"], F.when(s["seen"] + x["c"] > rank, x["n"])).alias("v"))
        return F.aggregate("h", start, step, lambda s: s["v"])

    return hist.select("notes", "chars", "longest", at(0.5).alias("p50"), at(0.9).alias("p90"), at(0.99).alias("p99"))


@query("""SELECT 'source' AS facet, source AS value, count(*) AS n FROM documents GROUP BY source UNION ALL SELECT 'lang', lang, count(*) FROM documents GROUP BY lang""")
def facet_counts(spark: SparkSession, d: str) -> DataFrame:
    facets = F.explode(F.map_from_arrays(F.array(F.lit("source"), F.lit("lang")), F.array("source", "lang")))
    return table(spark, d, "documents").select(facets.alias("facet", "value")).groupBy("facet", "value").agg(F.count("*").alias("n"))


@query("""WITH w AS (SELECT lang, unnest(regexp_extract_all(lower(text), '[a-z]{4,}')) AS tag FROM documents), c AS (SELECT lang, tag, count(*) AS n FROM w GROUP BY ALL)
SELECT lang, tag, n, row_number() OVER (PARTITION BY lang ORDER BY n DESC, tag)::INT AS rank FROM c QUALIFY rank <= 30""")
def top_tags(spark: SparkSession, d: str) -> DataFrame:
    words = table(spark, d, "documents").select("lang", F.explode(F.regexp_extract_all(F.lower("text"), F.lit("[a-z]{4,}"), 0)).alias("tag"))
    return top_k(words.groupBy("lang", "tag").agg(F.count("*").alias("n")), 30, ["lang"], F.desc("n"), "tag")


@query("SELECT source, doc_id, row_number() OVER (PARTITION BY source ORDER BY doc_id DESC)::INT AS rank FROM documents QUALIFY rank <= 15")
def recent_items(spark: SparkSession, d: str) -> DataFrame:
    return top_k(table(spark, d, "documents").select("source", "doc_id"), 15, ["source"], F.desc("doc_id"))


@query("SELECT source, sum(greatest(1, ceil(length(text) / 4)))::BIGINT AS tokens, round(sum(greatest(1, ceil(length(text) / 4))) * 0.0001, 4) AS cost FROM documents GROUP BY source")
def token_cost_estimate(spark: SparkSession, d: str) -> DataFrame:
    tokens = F.sum(T.estimated_tokens(F.col("text")))
    return table(spark, d, "documents").groupBy("source").agg(tokens.alias("tokens"), F.round(tokens * 0.0001, 4).alias("cost"))


@query("""SELECT page_id, trim(regexp_replace(regexp_replace(lower(trim(url)), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g')) AS slug, sha1(url)[1:8] AS short_hash FROM pages""")
def url_slugs(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "pages").select("page_id", T.slug(F.col("url")).alias("slug"), F.substring(F.sha1("url"), 1, 8).alias("short_hash"))


@query()
def artifact_ids(spark: SparkSession, d: str) -> DataFrame:
    """FNV-1a ids; without SQL, tested on known values."""
    return table(spark, d, "pages").select("page_id", T.fnv1a32(F.col("url")).alias("artifact_id"))
