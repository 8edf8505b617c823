"""Selections that depend on what was taken before, folded over one request's few rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def packed_context(rows: DataFrame, budget: int, zone_budget: int) -> DataFrame:
    """(request, id, place): rows (request, id, required, priority, score, zone, tokens) in the
    order required, priority, score, id, each taken if it fits the zone's and the whole budget."""
    order = F.struct((~F.col("required")).alias("o"), (-F.col("priority")).alias("p"), (-F.col("score")).alias("s"), "id", "zone", F.col("tokens").cast("long").alias("tokens"))
    listed = rows.groupBy("request").agg(F.array_sort(F.collect_list(order)).alias("rows"), F.array_sort(F.collect_set("zone")).alias("zones"))
    start = F.struct(
        F.array().cast("array<bigint>").alias("taken"), F.lit(0).cast("long").alias("used"),
        F.map_from_arrays("zones", F.transform("zones", lambda z: F.lit(0).cast("long"))).alias("by_zone"),
    )

    def step(s, r):
        fits = (s["used"] + r["tokens"] <= budget) & (s["by_zone"][r["zone"]] + r["tokens"] <= zone_budget)
        grown = F.transform_values(s["by_zone"], lambda k, v: F.when(k == r["zone"], v + r["tokens"]).otherwise(v))
        return F.struct(
            F.when(fits, F.concat(s["taken"], F.array(r["id"]))).otherwise(s["taken"]).alias("taken"),
            F.when(fits, s["used"] + r["tokens"]).otherwise(s["used"]).alias("used"),
            F.when(fits, grown).otherwise(s["by_zone"]).alias("by_zone"),
        )

    return listed.select("request", F.posexplode(F.aggregate("rows", start, step, lambda s: s["taken"])).alias("place", "id"))


def covered_groups(ranked: DataFrame, groups: DataFrame, limit: int) -> DataFrame:
    """(query_id, ref, place): for each required group (query_id, group_no, ref) the best row
    that no earlier group took, then the other rows in rank order, ``limit`` in all."""
    wanted = groups.groupBy("query_id", "group_no").agg(F.collect_set("ref").alias("refs"))
    wanted = wanted.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("group_no", "refs"))).alias("groups"))
    rows = ranked.groupBy("query_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "ref"))), lambda x: x["ref"]).alias("rows"))
    joined = rows.join(wanted, "query_id", "left")
    empty = F.array().cast(rows.schema["rows"].dataType)

    def take(picked, group):
        free = F.filter("rows", lambda r: F.array_contains(group["refs"], r) & ~F.array_contains(picked, r))
        return F.concat(picked, F.slice(free, 1, 1))

    first = F.when(F.col("groups").isNull(), empty).otherwise(F.aggregate("groups", empty, take))
    every = F.slice(F.array_distinct(F.concat(first, "rows")), 1, limit)
    return joined.select("query_id", F.posexplode(every).alias("place", "ref"))


def word_changes(pairs: DataFrame) -> DataFrame:
    """(id, kept, removed, added): words of two versions (old, new) by the longest common
    subsequence, folded row by row over the word table."""
    split = pairs.select("id", F.split(F.trim("old"), r"\s+").alias("a"), F.split(F.trim("new"), r"\s+").alias("b"))
    zero = F.transform(F.concat(F.array(F.lit("")), "b"), lambda x: F.lit(0))

    def next_row(row, word):
        def cell(acc, j):
            same = F.get("b", j - 1) == word
            value = F.when(same, F.get(row, j - 1) + 1).otherwise(F.greatest(F.get(row, j), F.element_at(acc, -1)))
            return F.concat(acc, F.array(value))

        return F.aggregate(F.sequence(F.lit(1), F.size("b")), F.array(F.lit(0)), cell)

    kept = F.element_at(F.aggregate("a", zero, next_row), -1)
    return split.select("id", kept.alias("kept"), (F.size("a") - kept).alias("removed"), (F.size("b") - kept).alias("added"))


#: How questions begin, what parts them, words that mean nothing alone, words too common to be asked alone, characters that make no
#: term, phrases with other names in the corpus, what is stripped off a variant.
QUESTION_PREFIX = r"^(?:什么是|什么|如何|怎么|怎样|为什么|为何|哪个|哪些|谁|何时|何地|请问|请告诉我|帮我|我想知道|我想了解)"
PARTS = r"[,，;；、。！？!?\s]+"
STOPWORDS = (
    "的", "是", "在", "了", "和", "与", "或", "及", "要", "为", "对", "这", "那", "什么", "如何", "怎么", "怎样", "为什么", "为何", "哪些",
    "哪个", "哪里", "请问", "请告诉我", "帮我", "我想知道", "我想了解", "what", "how", "why", "when", "where", "which", "who",
)
GENERIC = ("ai", "agent", "知识", "知识库", "笔记", "主题", "内容", "项目", "系统", "方法", "经验", "规模", "vault", "obsidian", "memory")
FUNCTION_CHARS = "的是在了和与或及要为对这那什么如何怎么怎样为什么为何哪些哪个哪里"
BRIDGES = ((r"(?i)(?:处理|执行).{0,8}(?:视频|B站).{0,8}(?:前|之前).*(?:注意|核对|准备)", ("B站视频处理前核对 bili_meta", "收件箱 B站处理前先核对", "视频任务处理前核对元信息")),)
STRIPPED = r"^[ ,，;；、。！？!?]+|[ ,，;；、。！？!?]+$"
ASCII_WORD = r"^[a-zA-Z0-9_.]+$"
HAN_RUN = r"[\x{3400}-\x{4dbf}\x{4e00}-\x{9fff}\x{f900}-\x{faff}]{2,}"


def query_variants(queries: DataFrame, most: int = 5) -> DataFrame:
    """(query_id, place, variant): other ways to ask ``queries`` (query_id, text), ``most`` at most, the question itself not among them.

    Questions that are empty, name one thing or ask for something absent get none, so that no name is widened into an answer. Then in order: other
    names of known phrases, the question without its opening, its parts from the longest on, its words that mean something, its
    distinctive identifiers, pairs of Chinese characters from both ends. Each once whatever its case."""
    from corpusmill.functions.queries import question_kind, squeezed
    from corpusmill.functions.text import split_keywords

    none = F.array().cast("array<string>")
    rows = queries.select("query_id", squeezed(F.col("text")).alias("asked")).where(~question_kind(F.col("asked")).isin("empty", "identifier", "negative"))
    rows = rows.withColumn("cleaned", F.trim(F.regexp_replace("asked", QUESTION_PREFIX, "")))
    rows = rows.withColumn("base", F.when(F.col("cleaned") == "", F.col("asked")).otherwise(F.col("cleaned")))
    bridges = F.concat(*[F.when(F.col("asked").rlike(p), F.array(*map(F.lit, names))).otherwise(none) for p, names in BRIDGES], none)
    cleaned = F.when(F.col("cleaned") != F.col("asked"), F.array("cleaned")).otherwise(none)
    segments = F.array_distinct(F.filter(F.split("base", "(?U)" + PARTS), lambda x: F.length(x) >= 3))
    longest = F.transform(F.array_sort(F.transform(segments, lambda x: F.struct((-F.length(x)).alias("n"), x.alias("x")))), lambda s: s["x"])
    tokens = F.filter(split_keywords(F.col("base")), lambda t: ~F.lower(t).isin(*STOPWORDS) & ((F.length(t) >= 2) | t.rlike(ASCII_WORD)))
    phrase = F.when(F.size(tokens) >= 2, F.array(F.array_join(tokens, " "))).otherwise(none)
    names = F.filter(tokens, lambda t: t.rlike(ASCII_WORD) & (F.length(t) >= 3) & ~F.lower(t).isin(*GENERIC))
    pairs = lambda run: F.transform(F.sequence(F.lit(1), F.length(run) - 1), lambda i: F.substr(run, i, F.lit(2)))
    han = F.array_distinct(F.filter(F.flatten(F.transform(F.regexp_extract_all("base", F.lit(HAN_RUN), 0), pairs)), lambda t: ~t.rlike(f"[{FUNCTION_CHARS}]") & ~F.lower(t).isin(*GENERIC)))
    ends = F.array_distinct(F.concat(F.slice(han, 1, 2), F.slice(F.reverse(F.slice(F.reverse(han), 1, 2)), 1, 2), han))
    every = F.transform(F.concat(bridges, cleaned, longest, phrase, names, ends), lambda v: F.regexp_replace(F.trim(F.regexp_replace(v, r"(?U)\s+", " ")), STRIPPED, ""))
    low = F.transform(every, F.lower)
    fresh = F.filter(every, lambda v, i: (F.length(v) >= 2) & (F.lower(v) != F.lower("asked")) & (F.array_position(low, F.lower(v)) == i + 1))
    return rows.select("query_id", F.posexplode(F.slice(fresh, 1, most)).alias("place", "variant"))


#: Fixed value: a citation is ``[n]`` or ``[[ref]]`` outside code.
CITATION = r"\[\[([^\[\]]+)\]\]|\[(\d+)\]"


def citations(answers: DataFrame) -> DataFrame:
    """(id, place, ref) of the citations in ``answers`` (id, answer), code spans masked."""
    bare = F.regexp_replace(F.regexp_replace("answer", r"(?s)```.*?```", " "), r"`[^`]*`", " ")
    found = F.regexp_extract_all(bare, F.lit(CITATION), 0)
    return answers.select("id", F.posexplode(F.array_distinct(F.transform(found, lambda r: F.regexp_replace(r, r"[\[\]]", "")))).alias("place", "ref"))


def expanded_context(chunks: DataFrame, near: int, limit: int) -> DataFrame:
    """(entry, heading, place, ref, content, context_of): each chunk's text, then those of up to ``near`` chunks
    before and after it under its heading, each after a mark with its reference, as long as they fit ``limit``.

    ``chunks``: entry, heading, place, ref, text."""
    w = Window.partitionBy("entry", "heading").orderBy("place")
    one = F.struct("ref", "text")
    around = F.concat(F.collect_list(one).over(w.rowsBetween(-near, -1)), F.collect_list(one).over(w.rowsBetween(1, near)))
    begin = F.struct(F.left("text", F.lit(limit)).alias("content"), F.array().cast("array<string>").alias("used"), F.lit(False).alias("full"))

    def step(s, c):
        mark = F.concat(F.lit("\n\n[context_of:"), c["ref"], F.lit("]\n"))
        room = F.lit(limit) - F.length(s["content"]) - F.length(mark)
        fits = ~s["full"] & (room > 0)
        return F.struct(
            F.when(fits, F.concat(s["content"], mark, F.left(c["text"], room))).otherwise(s["content"]).alias("content"),
            F.when(fits, F.concat(s["used"], F.array(c["ref"]))).otherwise(s["used"]).alias("used"),
            (s["full"] | ~fits | (F.length(c["text"]) > room)).alias("full"),
        )

    folded = chunks.withColumn("around", around).withColumn("s", F.aggregate("around", begin, step))
    return folded.select("entry", "heading", "place", "ref", "s.content", F.array_join("s.used", "|").alias("context_of"))
