"""Bucket notes: many memory entries under ``## mem-…`` headings in one note."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpusmill.operators.chunking import spans

#: The format of an entry's heading and of its line of properties.
HEAD = r"^##\s+(mem-[0-9a-f]+)\s*$"
META = r"^\s*>.*(importance|tags|created|project|source|updated)="


def bucket_entries(notes: DataFrame) -> DataFrame:
    """(path, entry_index, mem_id, anchor, importance, tags, project, created, content, start) of notes
    (path, text). A repeated id's anchor is numbered; headings within fences are text. ``start`` is the place
    in the note where the content begins."""
    w = Window.partitionBy("path").orderBy("n")
    rows = notes.select("path", F.posexplode(spans(F.split("text", "\n"), 1)).alias("n", "u"))
    lines = rows.select("path", "n", F.regexp_replace(F.col("u")["t"], "\r$", "").alias("line"), F.col("u")["s"].alias("at"))
    fence = F.col("line").rlike(r"^\s*(```|~~~)")
    open_fences = F.coalesce(F.sum(fence.cast("int")).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    lines = lines.withColumn("head", (open_fences % 2 == 0) & F.col("line").rlike(HEAD))
    lines = lines.withColumn("entry", F.sum(F.col("head").cast("int")).over(w)).where("entry > 0")
    gathered = lines.groupBy("path", "entry").agg(F.array_sort(F.collect_list(F.struct("n", "line", "at"))).alias("all"))
    text = F.transform("all", lambda x: x["line"])
    meta = F.array_join(F.filter(F.slice(text, 2, F.size(text)), lambda x: x.rlike(META)), " | ")
    pairs = F.filter(F.split(F.regexp_replace(meta, r"^\s*>\s*", ""), r"\s*\|\s*>?\s*"), lambda x: F.contains(x, F.lit("=")))
    keys = F.map_from_entries(F.transform(pairs, lambda p: F.struct(F.trim(F.substring_index(p, "=", 1)), F.trim(F.substring_index(p, "=", -1)))))
    told = F.filter(F.slice("all", 2, F.size("all")), lambda x: ~x["line"].rlike(META) & (F.trim(x["line"]) != ""))
    first = F.get(told, F.lit(0))["at"]
    body = F.trim(F.array_join(F.filter(F.slice(text, 2, F.size(text)), lambda x: ~x.rlike(META)), "\n"))
    out = gathered.select("path", (F.col("entry") - 1).alias("entry_index"), F.regexp_extract(F.element_at(text, 1), HEAD, 1).alias("mem_id"), keys.alias("meta"), body.alias("content"), F.coalesce(first, F.lit(0)).alias("start"))
    again = F.row_number().over(Window.partitionBy("path", "mem_id").orderBy("entry_index")) - 1
    tags = F.filter(F.split(F.coalesce(F.col("meta")["tags"], F.lit("")), r"\s*[,，、;；]\s*"), lambda t: t != "")
    return out.select(
        "path", "entry_index", "mem_id", F.when(again > 0, F.concat("mem_id", F.lit(":d"), again.cast("string"))).otherwise(F.col("mem_id")).alias("anchor"),
        F.col("meta")["importance"].try_cast("int").alias("importance"), tags.alias("tags"), F.col("meta")["project"].alias("project"),
        F.try_to_timestamp(F.col("meta")["created"]).alias("created"), F.regexp_replace("content", r"^\s*\n|\s+$", "").alias("content"), "start",
    )
