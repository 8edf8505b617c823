"""Structure-aware chunking of Markdown notes as window and array expressions.

Lines are numbered, classified and gathered to blocks by running sums over a note; no
note's lines leave its own window. Sections of prose are packed greedily by one fold
over the section's blocks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

TARGET, HARD, OVERLAP = 500, 800, 80
#: Markdown's marks of code fences and list items.
FENCES, BULLETS = ("```", "~~~"), ("-", "*", "+")


def fence_mark(line: Column) -> Column:
    return F.left(F.ltrim(line), F.lit(3)).isin(*FENCES)


def line_kind(line: Column) -> Column:
    """What a line outside a fence is, told by its first word and its ends."""
    body = F.trim(line)
    first = F.substring_index(body, " ", 1)
    more = F.length(body) > F.length(first)
    hashes = (F.translate(first, "#", "") == "") & (F.length(first) <= 6) & F.startswith(line, F.lit("#"))
    number = F.rtrim(F.translate(first, "0123456789", ""))
    counted = number.isin(".", ")") & (F.length(first) > 1) & F.endswith(first, number)
    return (
        F.when(body == "", "blank")
        .when(hashes & more, "heading")
        .when(F.startswith(body, F.lit("|")) & F.endswith(body, F.lit("|")) & (F.length(body) > 1), "table")
        .when(F.startswith(body, F.lit(">")), "callout")
        .when((first.isin(*BULLETS) | counted) & (more | (F.length(F.ltrim(line)) > F.length(first))), "list")
        .otherwise("paragraph")
    )


#: A stretch of a text: its words, and where it begins and ends in its source.
SPAN = "array<struct<t: string, s: int, e: int>>"


def spans(parts: Column, between: int) -> Column:
    """Parts of one text, ``between`` characters apart, with their places in it."""
    start = F.struct(F.array().cast(SPAN).alias("done"), F.lit(0).alias("at"))

    def step(s: Column, t: Column) -> Column:
        end = s["at"] + F.length(t)
        return F.struct(F.concat(s["done"], F.array(F.struct(t.alias("t"), s["at"].alias("s"), end.alias("e")))).alias("done"), (end + between).alias("at"))

    return F.aggregate(parts, start, step, lambda s: s["done"])


def trimmed(span: Column) -> Column:
    """Without spaces at its ends."""
    t = span["t"]
    return F.struct(F.trim(t).alias("t"), (span["s"] + F.length(t) - F.length(F.ltrim(t))).alias("s"), (span["e"] - F.length(t) + F.length(F.rtrim(t))).alias("e"))


def sliced(span: Column, limit: int | Column) -> Column:
    """A stretch in pieces of at most ``limit`` characters."""
    starts = F.sequence(F.lit(1), F.greatest(F.length(span["t"]), F.lit(1)), F.lit(limit))
    piece = lambda i: F.substr(span["t"], i, F.lit(limit))
    return F.transform(starts, lambda i: F.struct(piece(i).alias("t"), (span["s"] + i - 1).alias("s"), (span["s"] + i - 1 + F.length(piece(i))).alias("e")))


def packed(units: Column, limit: int | Column, joint: str) -> Column:
    """Neighbouring stretches joined while they fit ``limit``."""
    none = F.lit(None).cast("struct<t: string, s: int, e: int>")
    start = F.struct(F.array().cast(SPAN).alias("done"), none.alias("open"))

    def step(s: Column, u: Column) -> Column:
        empty = s["open"].isNull() | (s["open"]["t"] == "")
        fits = empty | (F.length(s["open"]["t"]) + F.length(u["t"]) + len(joint) <= limit)
        both = F.struct(F.concat(s["open"]["t"], F.lit(joint), u["t"]).alias("t"), s["open"]["s"].alias("s"), u["e"].alias("e"))
        return F.struct(
            F.when(fits, s["done"]).otherwise(F.concat(s["done"], F.array(s["open"]))).alias("done"),
            F.when(empty | ~fits, u).otherwise(both).alias("open"),
        )

    return F.aggregate(units, start, step, lambda s: F.when(s["open"].isNull() | (s["open"]["t"] == ""), s["done"]).otherwise(F.concat(s["done"], F.array(s["open"]))))


def all_sliced(units: Column, limit: int | Column) -> Column:
    return F.flatten(F.transform(units, lambda u: sliced(u, limit)))


def list_pieces(text: Column, limit: int) -> Column:
    """A list cut before items of its outer level, and only an item over the limit within."""
    items = F.split(text, r"\n(?=[-*+] |[0-9]+[.)] )")
    return packed(all_sliced(spans(items, 1), limit), limit, "\n")


def table_pieces(text: Column, limit: int) -> Column:
    """A table cut between rows; each piece begins with the table's head, and its place is that of its rows."""
    lines = F.split(text, "\n")
    ruled = F.translate(F.coalesce(F.get(lines, F.lit(1)), F.lit("x")), "|:- ", "") == ""
    n = F.when(ruled, 2).otherwise(1)
    head = F.array_join(F.slice(lines, F.lit(1), n), "\n")
    room = F.greatest(F.lit(limit) - F.length(head) - 1, F.lit(1))
    rows = F.slice(spans(lines, 1), n + 1, F.size(lines))
    return F.transform(packed(all_sliced(rows, room), room, "\n"), lambda p: F.struct(F.concat(head, F.lit("\n"), p["t"]).alias("t"), p["s"].alias("s"), p["e"].alias("e")))


def fence_pieces(text: Column, limit: int) -> Column:
    """A code block cut between lines; each piece is opened and closed like the whole, and its place is that of its lines."""
    lines = F.split(text, "\n")
    opening = F.get(lines, F.lit(0))
    mark = F.left(F.ltrim(opening), F.lit(3))
    closed = (F.size(lines) > 1) & F.startswith(F.ltrim(F.element_at(lines, -1)), mark)
    body = F.slice(spans(lines, 1), F.lit(2), F.size(lines) - 1 - closed.cast("int"))
    room = F.greatest(F.lit(limit) - F.length(opening) - 5, F.lit(1))
    pieces = packed(all_sliced(body, room), room, "\n")
    return F.transform(pieces, lambda p: F.struct(F.concat(opening, F.lit("\n"), p["t"], F.lit("\n"), mark).alias("t"), p["s"].alias("s"), p["e"].alias("e")))


def whole(text: Column) -> Column:
    return F.array(F.struct(text.alias("t"), F.lit(0).alias("s"), F.length(text).alias("e")))


def block_pieces(kind: Column, text: Column, limit: int) -> Column:
    """A block that isn't prose in pieces of at most ``limit`` characters, cut where its kind allows."""
    return (
        F.when(F.length(text) <= limit, whole(text))
        .when(kind == "list", list_pieces(text, limit))
        .when(kind == "table", table_pieces(text, limit))
        .when(kind == "fence", fence_pieces(text, limit))
        .otherwise(packed(all_sliced(spans(F.split(text, "\n"), 1), limit), limit, "\n"))
    )


def moved(units: Column, by: Column) -> Column:
    return F.transform(units, lambda u: F.struct(u["t"].alias("t"), (u["s"] + by).alias("s"), (u["e"] + by).alias("e")))


def paragraph_chunks(notes: DataFrame, limit: int = 600) -> DataFrame:
    """(path, chunk_index, content): blank-line paragraphs, long ones cut after the last
    full stop in reach, short neighbours joined up to ``limit``. ``notes``: path, text."""
    paragraphs = F.filter(F.transform(F.split("text", r"\r?\n\r?\n"), F.trim), lambda p: p != "")
    cut = F.flatten(F.transform(paragraphs, lambda p: F.when(F.length(p) <= limit, whole(p)).otherwise(F.filter(sentences(p, limit), lambda x: x["t"] != ""))))
    chunks = notes.select("path", F.posexplode(packed(cut, limit, "\n")).alias("chunk_index", "span"))
    return chunks.select("path", "chunk_index", F.col("span")["t"].alias("content")).where("content <> ''")


def sentences(text: Column, limit: int) -> Column:
    """Whole sentences packed up to ``limit``; a sentence over it is sliced."""
    marked = F.regexp_replace(text, r"([。！？!?]|\.(?=\s))", "$1\0")
    parts = F.filter(spans(F.split(marked, "\0"), 0), lambda u: u["t"] != "")
    return packed(all_sliced(F.transform(parts, trimmed), limit), limit, " ")


def numbered_lines(notes: DataFrame) -> DataFrame:
    """(path, n, line, at) of the lines after the front matter: ``at`` is where a line begins in the note."""
    body = F.regexp_replace("text", r"(?s)\A---\s*\r?\n.*?\r?\n---\s*(\r?\n|\z)", "")
    rows = notes.select("path", (F.length("text") - F.length(body)).alias("begin"), spans(F.split(body, "\n"), 1).alias("lines"))
    return rows.select("path", "begin", F.posexplode("lines").alias("n", "u")).select("path", "n", F.regexp_replace(F.col("u")["t"], "\r$", "").alias("line"), (F.col("begin") + F.col("u")["s"]).alias("at"))


def blocks(notes: DataFrame) -> DataFrame:
    """(path, block, kind, heading_path, text, at): runs of lines of one kind under one heading, and
    where each begins in the note. Lines end with one character, so places in notes with CRLF are off by the lines before in the block."""
    w = Window.partitionBy("path").orderBy("n")
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    lines = numbered_lines(notes)
    marker = fence_mark(F.col("line"))
    lines = lines.withColumn("marks", F.coalesce(F.sum(marker.cast("int")).over(before), F.lit(0)))
    inside = (F.col("marks") % 2 == 1) | marker
    lines = lines.withColumn("kind", F.when(inside, "fence").otherwise(line_kind(F.col("line"))))
    level = F.when(F.col("kind") == "heading", F.length(F.regexp_extract("line", r"^(#+)", 1)))
    lines = lines.withColumn("level", level).withColumn("title", F.trim(F.regexp_replace("line", r"^#+\s+", "")))
    held = [F.last(F.when(F.col("level") == i, F.struct("n", "title")), True).over(w) for i in range(1, 7)]
    lines = lines.withColumn("held", F.array(*held))
    above = lambda h, i: F.coalesce(F.array_max(F.transform(F.slice("held", 1, i), lambda x: x["n"])), F.lit(-1))
    valid = F.filter("held", lambda h, i: h.isNotNull() & (h["n"] > F.when(i > 0, above(h, i)).otherwise(-1)))
    lines = lines.withColumn("heading_path", F.transform(valid, lambda h: h["title"]))
    opened = (F.col("kind") == "fence") & marker & (F.col("marks") % 2 == 0)
    new = (F.col("kind") == "heading") | opened | (F.col("kind") != F.coalesce(F.lag("kind").over(w), F.lit("")))
    lines = lines.withColumn("block", F.sum(new.cast("int")).over(w))
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n", "line"))), lambda x: x["line"]), "\n")
    return (
        lines.where("kind <> 'blank'")
        .groupBy("path", "block")
        .agg(F.first("kind").alias("kind"), F.first("heading_path").alias("heading_path"), text.alias("text"), F.min("at").alias("at"))
    )


def anchor_of(heading_path: Column) -> Column:
    """A slug of the headings, or ``doc``."""
    clean = F.trim(F.regexp_replace(F.array_join(heading_path, " "), r'[\\/:*?"<>|#\[\]]', ""))
    slug = F.substring(F.regexp_replace(clean, r"\s+", "-"), 1, 40)
    return F.when(F.size(heading_path) == 0, "doc").when(slug == "", "section").otherwise(slug)


def _identified(pieces: DataFrame) -> DataFrame:
    """Chunk numbers, stable ids (a hash of anchor and content; repeats numbered) and overlap."""
    order = Window.partitionBy("path").orderBy("block", "piece")
    same = Window.partitionBy("path", "anchor", "content").orderBy("block", "piece")
    again = F.row_number().over(same) - 1
    key = F.concat_ws("|", "anchor", "content", F.when(again > 0, F.concat(F.lit("duplicate-"), again.cast("string"))))
    out = pieces.withColumn("ref", F.concat("path", F.lit("#"), "anchor", F.lit(":ch"), F.substring(F.sha1(key), 1, 8)))
    out = out.withColumn("chunk_index", F.row_number().over(Window.partitionBy("path", "anchor").orderBy("block", "piece")) - 1)
    was = F.lag(F.struct("anchor", "kind", "content")).over(order)
    tail = F.right(was["content"], F.least(F.lit(OVERLAP), F.greatest(F.lit(0), HARD - F.length("content") - 1)))
    joined = (was["anchor"] == F.col("anchor")) & (was["kind"] == "paragraph") & (F.col("kind") == "paragraph")
    content = F.when(joined & (tail != ""), F.concat(tail, F.lit("\n"), F.col("content"))).otherwise(F.col("content"))
    return out.withColumn("indexed", content)


def structure_chunks(notes: DataFrame) -> DataFrame:
    """(path, ref, anchor, kind, heading_path, chunk_index, content, indexed, start, end): prose packed to
    ``TARGET`` within a heading, other blocks whole, nothing over ``HARD`` characters. ``start`` and ``end``
    are places in the note: what stands between them is the content, but for the white space between its
    parts and for the heads that pieces of tables and code repeat."""
    b = blocks(notes).withColumn("anchor", anchor_of(F.col("heading_path")))
    w = Window.partitionBy("path").orderBy("block")
    turn = (F.col("kind") != "paragraph") | (F.coalesce(F.lag("kind").over(w), F.lit("")) != "paragraph") | (F.lag("anchor").over(w) != F.col("anchor"))
    runs = b.withColumn("run", F.sum(turn.cast("int")).over(w))
    texts = F.array_sort(F.collect_list(F.struct("block", "text", "at")))
    grouped = runs.groupBy("path", "run").agg(
        F.min("block").alias("block"), F.first("kind").alias("kind"), F.first("anchor").alias("anchor"), F.first("heading_path").alias("heading_path"), texts.alias("texts")
    )
    own = lambda cut: F.flatten(F.transform("texts", lambda x: moved(cut(x["text"]), x["at"])))
    prose = packed(own(lambda t: F.when(F.length(t) > HARD, sentences(t, HARD)).otherwise(whole(t))), TARGET, "\n")
    pieces = F.when(F.col("kind") == "paragraph", prose).otherwise(own(lambda t: block_pieces(F.col("kind"), t, HARD)))
    out = grouped.select("path", "block", "kind", "anchor", "heading_path", F.posexplode(pieces).alias("piece", "span"))
    out = out.select("path", "block", "kind", "anchor", "heading_path", "piece", F.col("span")["t"].alias("content"), F.col("span")["s"].alias("start"), F.col("span")["e"].alias("end"))
    return _identified(out.where("trim(content) <> ''"))


#: Fixed value: reasons of a chunk that short prose may join.
PROSE = ("paragraph", "short_merge", "heading_prefix")
MERGE = "array<struct<kind: string, reason: string, content: string, s: int, e: int>>"


def merged_runs(parts: Column, least: int) -> Column:
    """The chunks of one heading, in order, after two folds: a heading goes before what follows it, then prose
    joins the prose before it, again and again, while either is shorter than ``least`` and both fit ``HARD``."""
    none = F.array().cast(MERGE)
    bare = lambda c: F.regexp_replace(c, r"^[\r\n]+|[\r\n]+$", "")
    last = lambda done: F.get(done, F.size(done) - 1)
    but_last = lambda done: F.slice(done, F.lit(1), F.greatest(F.size(done) - 1, F.lit(0)))

    def joined(x: Column, y: Column, reason: str) -> Column:
        content = F.array_join(F.filter(F.array(bare(x["content"]), bare(y["content"])), lambda c: c != ""), "\n")
        return F.struct(y["kind"].alias("kind"), F.lit(reason).alias("reason"), content.alias("content"), F.least(x["s"], y["s"]).alias("s"), F.greatest(x["e"], y["e"]).alias("e"))

    def named(done: Column, x: Column) -> Column:
        h = last(done)
        goes = (h["reason"] == "heading") & (x["kind"] != "heading") & (F.length(h["content"]) + F.length(x["content"]) + 1 <= HARD)
        return F.when(F.coalesce(goes, F.lit(False)), F.concat(but_last(done), F.array(joined(h, x, "heading_prefix")))).otherwise(F.concat(done, F.array(x)))

    def short(done: Column, x: Column) -> Column:
        h = last(done)
        prose = h["reason"].isin(*PROSE) & x["reason"].isin(*PROSE)
        small = (F.length(bare(h["content"])) < least) | (F.length(bare(x["content"])) < least)
        fits = F.length(joined(h, x, "")["content"]) <= HARD
        return F.when(F.coalesce(prose & small & fits, F.lit(False)), F.concat(but_last(done), F.array(joined(h, x, "short_merge")))).otherwise(F.concat(done, F.array(x)))

    return F.aggregate(F.aggregate(parts, none, named), none, short)


def merged_chunks(chunks: DataFrame, least: int = 64) -> DataFrame:
    """Headings put before the chunk that follows them in their section, and prose shorter
    than ``least`` joined to the prose before it, in chains, where all together fits ``HARD``. Adds ``reason``."""
    w = Window.partitionBy("path").orderBy("block", "piece")
    turn = F.coalesce(F.lag("anchor").over(w) != F.col("anchor"), F.lit(True))
    runs = chunks.withColumn("run", F.sum(turn.cast("int")).over(w))
    part = F.struct("block", "piece", F.struct("kind", F.col("kind").alias("reason"), "content", F.col("start").alias("s"), F.col("end").alias("e")).alias("part"))
    own = F.transform(F.array_sort(F.collect_list(part)), lambda x: x["part"]).cast(MERGE)
    sections = runs.groupBy("path", "run").agg(F.first("anchor").alias("anchor"), F.first("heading_path").alias("heading_path"), F.min("block").alias("block"), own.alias("parts"))
    out = sections.select("path", "block", "anchor", "heading_path", F.posexplode(merged_runs(F.col("parts"), least)).alias("piece", "m"))
    return _identified(out.select("path", "block", "piece", "anchor", "heading_path", F.col("m")["kind"].alias("kind"), F.when(F.col("m")["reason"] == "heading", "heading_only").otherwise(F.col("m")["reason"]).alias("reason"),
                                  F.col("m")["content"].alias("content"), F.col("m")["s"].alias("start"), F.col("m")["e"].alias("end")))


def coverage(notes: DataFrame, chunks: DataFrame) -> DataFrame:
    """(path, source_chars, covered_chars, coverage): characters that aren't white space, of a note without its
    front matter and of the union of its chunks' places. The union comes from a running maximum of ends."""
    w = Window.partitionBy("path").orderBy("start", "end")
    reached = F.max("end").over(w.rowsBetween(Window.unboundedPreceding, -1))
    islands = chunks.select("path", "start", "end").withColumn("new", F.coalesce(F.col("start") > reached, F.lit(True)).cast("int"))
    merged = islands.withColumn("island", F.sum("new").over(w)).groupBy("path", "island").agg(F.min("start").alias("start"), F.max("end").alias("end"))
    held = merged.groupBy("path").agg(F.collect_list(F.struct("start", "end")).alias("islands"))
    solid = lambda c: F.length(F.regexp_replace(c, r"(?U)\s+", ""))
    inside = F.aggregate("islands", F.lit(0), lambda n, i: n + solid(F.substr("text", i["start"] + 1, i["end"] - i["start"])))
    body = F.regexp_replace("text", r"(?s)\A---\s*\r?\n.*?\r?\n---\s*(\r?\n|\z)", "")
    out = notes.join(held, "path", "left").select("path", solid(body).alias("source_chars"), F.coalesce(inside, F.lit(0)).alias("inside"))
    out = out.withColumn("covered_chars", F.least("source_chars", "inside")).drop("inside")
    return out.withColumn("coverage", F.when(F.col("source_chars") > 0, F.round(F.col("covered_chars") / F.col("source_chars"), 3)).otherwise(0.0))


def bucket_chunks(notes: DataFrame) -> DataFrame:
    """The chunks of bucket notes (path, text): those of each entry alone, under its own anchor; places are in the note."""
    from corpusmill.operators.buckets import bucket_entries

    entries = bucket_entries(notes).select("path", "entry_index", "mem_id", "anchor", "tags", "content", "start")
    keyed = entries.withColumn("note", F.to_json(F.struct("path", "entry_index")))
    own = structure_chunks(keyed.select(F.col("note").alias("path"), F.col("content").alias("text"))).select(F.col("path").alias("note"), "block", "piece", "kind", "heading_path", "content", F.col("start").alias("from"), F.col("end").alias("to"))
    out = own.join(keyed.drop("content"), "note").withColumn("block", F.col("entry_index") * 1_000_000 + F.col("block"))
    return _identified(out.select("path", "block", "piece", "kind", "heading_path", "anchor", "mem_id", "tags", "content", (F.col("start") + F.col("from")).alias("start"), (F.col("start") + F.col("to")).alias("end")))


#: The names of what may be wrong with a note's chunks, what is worth a warning, and the limits.
TINY, COVERED = 50, 0.95
PROBLEMS = {
    "no_chunks": "chunks = 0",
    "single_chunk_for_large_document": f"chunks = 1 AND source_chars > {max(HARD, 2 * TARGET)}",
    "chunk_exceeds_hard_bound": f"longest > {HARD}",
    "too_many_tiny_chunks": "tiny > greatest(2, chunks div 4)",
    "all_chunks_far_below_target": f"chunks > 0 AND source_chars > {TARGET} AND longest < {TARGET // 4}",
}


def validation(notes: DataFrame, chunks: DataFrame) -> DataFrame:
    """(path, chunks, shortest, longest, mean, source_chars, covered_chars, coverage, problems, warnings, ok) of every
    note (path, text). The last chunk of a note may be short."""
    size = F.length("content")
    last = F.row_number().over(Window.partitionBy("path").orderBy(F.desc("block"), F.desc("piece"))) == 1
    per = chunks.withColumn("last", last).groupBy("path").agg(
        F.count("*").alias("chunks"), F.min(size).alias("shortest"), F.max(size).alias("longest"), F.round(F.avg(size), 1).alias("mean"), F.count_if((size < TINY) & ~F.col("last")).alias("tiny"),
    )
    every = coverage(notes, chunks).join(per, "path", "left").fillna({"chunks": 0, "shortest": 0, "longest": 0, "mean": 0.0, "tiny": 0})
    problems = F.array_compact(F.array(*[F.when(F.expr(rule), name) for name, rule in PROBLEMS.items()]))
    warned = F.when((F.col("chunks") > 0) & (F.col("coverage") < COVERED), "coverage_below_95_percent").otherwise("")
    return every.select("path", "chunks", "shortest", "longest", "mean", "source_chars", "covered_chars", "coverage", F.array_join(problems, "|").alias("problems"), warned.alias("warnings"), (F.size(problems) == 0).alias("ok"))
