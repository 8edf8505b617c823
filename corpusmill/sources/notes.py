"""Sources of notes, logs and feeds, and the derived sinks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: Fixed value: folders that a scan of notes leaves out.
SKIPPED = r"(^|/)(\.obsidian|\.trash|\.git|node_modules|archive)/"


def scan_notes(spark: SparkSession, root: str, prefixes: list[str] | None = None) -> DataFrame:
    """(path, mtime, text) of all Markdown files below ``root``, system folders left out."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.md").load(root)
    base = root.rstrip("/").split("://")[-1]
    notes = files.select(
        F.substring_index("path", f"{base}/", -1).alias("path"), F.col("modificationTime").alias("mtime"), F.col("content").cast("string").alias("text")
    ).where(~F.col("path").rlike(SKIPPED))
    if prefixes:
        keep = F.lit(False)
        for p in prefixes:
            keep = keep | F.startswith("path", F.lit(p.strip("/") + "/")) | (F.col("path") == p.strip("/"))
        notes = notes.where(keep)
    return notes


def with_frontmatter(notes: DataFrame) -> DataFrame:
    """``notes`` with ``meta`` (map), ``tags`` (array) and ``body`` from a leading YAML block."""
    block = F.regexp_extract("text", r"(?s)\A---\s*\r?\n(.*?)\r?\n---\s*(?:\r?\n|\z)", 1)
    pairs = F.filter(F.split(block, r"\r?\n"), lambda line: line.rlike(r"^[^\s:#-][^:]*:"))
    entry = lambda line: F.struct(F.trim(F.substring_index(line, ":", 1)).alias("k"), F.trim(F.regexp_replace(line, r"^[^:]*:", "")).alias("v"))
    meta = F.map_from_entries(F.transform(pairs, entry))
    inline = F.filter(F.split(F.regexp_replace(F.coalesce(meta["tags"], F.lit("")), r"[\[\]'\"]", ""), r"\s*,\s*"), lambda t: t != "")
    listed = F.transform(F.regexp_extract_all(F.regexp_extract(block, r"(?s)(?:^|\n)tags:\s*\n((?:\s*-[^\n]*\n?)+)", 1), F.lit(r"-\s*([^\n]+)"), 1), F.trim)
    body = F.regexp_replace("text", r"(?s)\A---\s*\r?\n.*?\r?\n---\s*(\r?\n|\z)", "")
    return notes.withColumns({"meta": meta, "tags": F.array_distinct(F.concat(inline, listed)), "body": body})


def read_jsonl(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    """JSON lines; torn or malformed lines are left out."""
    return spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path)


def read_jsonl_until_bad(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON lines of each file (file, at, ...) up to its first malformed one. Lines are read in splits, and ``at`` is a line's place: the start of
    its split, then its order there. One row a file tells where it first breaks, so no task holds a file."""
    lines = spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), F.struct(F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("n")).alias("at"), F.col("value").alias("line"))
    rows = lines.where("trim(line) <> ''").withColumn("bad", F.get_json_object("line", "$").isNull())
    first = rows.where("bad").groupBy("file").agg(F.min("at").alias("broken"))
    return rows.join(first, "file", "left").where("broken IS NULL OR at < broken").withColumn("r", F.from_json("line", schema, {"mode": "PERMISSIVE"})).select("file", "at", "r.*")


def read_list(spark: SparkSession, path: str) -> DataFrame:
    """One value a line; blank lines and ``#`` comments are left out."""
    return spark.read.text(path).select(F.trim("value").alias("value")).where("value <> '' AND value NOT LIKE '#%'")


#: What is read of a feed: RSS has items in a channel or beside it, Atom has entries; links are text or an attribute.
FEED_ITEM = "struct<title: string, link: array<struct<_VALUE: string, _href: string, _rel: string>>, description: string, summary: string, pubDate: string, updated: string>"
FEED = f"channel struct<item: array<{FEED_ITEM}>>, item array<{FEED_ITEM}>, entry array<{FEED_ITEM}>, broken string"


def parsed_feeds(feeds: DataFrame) -> DataFrame:
    """``feeds`` (url, xml) with ``items``, ``entries`` and ``broken``: what of a text isn't XML."""
    options = {"ignoreNamespace": "true", "mode": "PERMISSIVE", "columnNameOfCorruptRecord": "broken", "attributePrefix": "_", "valueTag": "_VALUE"}
    none = F.array().cast(f"array<{FEED_ITEM}>")
    read = feeds.withColumn("feed", F.from_xml("xml", FEED, options))
    items = F.concat(F.coalesce("feed.channel.item", none), F.coalesce("feed.item", none))
    return read.select(*feeds.columns, items.alias("items"), F.coalesce("feed.entry", none).alias("entries"), F.coalesce("feed.broken", F.lit("")).alias("broken"))


def feed_items(feeds: DataFrame) -> DataFrame:
    """(url, place, title, link, text, published) of the feeds (url, xml): RSS items, and where there are none Atom entries, with
    a title and a link. Text is without markup, at most 500 characters. What isn't XML gives nothing (``broken_feeds``)."""
    items = parsed_feeds(feeds)
    rss = F.transform("items", lambda i: F.struct(i["title"].alias("title"), F.get(F.filter(F.transform(i["link"], lambda x: F.trim(x["_VALUE"])), lambda x: x != ""), F.lit(0)).alias("link"), F.regexp_replace(i["description"], "<[^>]+>", "").alias("text"), F.trim(i["pubDate"]).alias("published")))
    atom = F.transform("entries", lambda i: F.struct(i["title"].alias("title"), F.get(i["link"], F.lit(0))["_href"].alias("link"), i["summary"].alias("text"), F.trim(i["updated"]).alias("published")))
    usable = lambda rows: F.filter(F.transform(rows, lambda r: F.struct(F.trim(F.regexp_replace(r["title"], r"^\s+|\s+$", "")).alias("title"), F.trim(r["link"]).alias("link"), F.substring(F.trim(F.coalesce(r["text"], F.lit(""))), 1, 500).alias("text"), r["published"].alias("published"))), lambda r: (F.coalesce(r["title"], F.lit("")) != "") & (F.coalesce(r["link"], F.lit("")) != ""))
    chosen = items.select("url", usable(rss).alias("rss"), usable(atom).alias("atom"))
    return chosen.select("url", F.posexplode(F.when(F.size("rss") > 0, F.col("rss")).otherwise(F.col("atom"))).alias("place", "i")).select("url", "place", "i.*")


def broken_feeds(feeds: DataFrame) -> DataFrame:
    """(url, broken) of the feeds that aren't XML."""
    return parsed_feeds(feeds).where("xml IS NOT NULL AND broken <> ''").select("url", "broken")


def page_item(pages: DataFrame) -> DataFrame:
    """(url, place, title, link, text) of single pages (url, name, html) that are followed like a feed: the page's own title, else its name; its
    description, else its text, at most 600 characters."""
    meta = lambda key: F.regexp_extract("html", rf"(?is)<meta[^>]*{key}[^>]*content=[\"']([^\"']*)", 1)
    bare = F.regexp_replace(F.regexp_replace(F.coalesce("html", F.lit("")), r"(?is)<script.*?</script>|<style.*?</style>", ""), "<[^>]+>", " ")
    text = F.coalesce(F.nullif(F.trim(meta("name=[\"']description[\"']")), F.lit("")), F.nullif(F.trim(meta("property=[\"']og:description[\"']")), F.lit("")), F.trim(F.regexp_replace(bare, r"\s+", " ")))
    title = F.coalesce(F.nullif(F.trim(F.regexp_extract("html", r"(?is)<title[^>]*>(.*?)</title>", 1)), F.lit("")), F.nullif(F.trim("name"), F.lit("")), F.lit("link"))
    return pages.where("url IS NOT NULL").select("url", F.lit(0).alias("place"), title.alias("title"), F.col("url").alias("link"), F.substring(text, 1, 600).alias("text"))


def append_new(new: DataFrame, known: DataFrame, key: list[str]) -> DataFrame:
    """The rows of ``new`` whose key is not known yet, one for each key."""
    return new.dropDuplicates(key).join(known.select(*key), key, "left_anti")


def compare_and_set(current: DataFrame, writes: DataFrame, key: str) -> DataFrame:
    """(key, revision, content, outcome): writes (key, expected, content) applied where the
    current revision (a hash of the content) is the expected one; the others conflict."""
    revision = F.substring(F.sha2("content", 256), 1, 16)
    now = current.select(key, F.col("content").alias("was"), revision.alias("revision"))
    ok = F.col("expected").eqNullSafe(F.col("revision"))
    outcome = F.when(F.col("content").isNull(), "kept").when(ok, "written").otherwise("conflict")
    merged = now.join(writes, key, "full_outer").withColumn("outcome", outcome)
    content = F.when(F.col("outcome") == "written", F.col("content")).otherwise(F.col("was"))
    return merged.select(key, content.alias("content"), "outcome").withColumn("revision", revision)


def write_log(rows: DataFrame, path: str, rows_per_file: int = 100_000) -> None:
    """JSON lines in bounded files."""
    rows.write.mode("append").option("maxRecordsPerFile", rows_per_file).json(path)
