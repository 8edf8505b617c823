"""Benchmark decontamination with a positional index, in DataFrame functions only.

The index is partitioned by document: it holds the postings of every document in
position order, as 64-bit hashes of its words, and is written once. The terms'
frequencies come from it. Each test window is looked up by its rarest terms: so many
that a near match must hold one of them, whichever terms it lacks. Each posting
of such a term begins an intersection: the lists of the window's other terms are read
around it, adjusted by their offsets, and only where enough of them meet is the place
confirmed, as an exact phrase and as a near match. That takes no shuffle; what is shuffled
are confirmed matches alone, by document and item, so neither a frequent term nor
a passage that thousands of documents share meets in one task.

The table of lookups grows with the test set, not with the documents. It is broadcast in
blocks of at most about ``MOST_LOOKUPS`` rows, each of which reads the index once.

Defined cases: a null or empty text has no words, is not contaminated and gives 0
counts (``items_sha256`` is then that of the empty string); a null ``doc_id`` is
judged as any other; a very long text is one row of the index and its matches are lists as long as
the text at most; repeated rows each get a row, and rows with equal ids are each
judged by their own text; items without words or with a null id are ignored, items
with equal ids are one item; other columns are ignored; empty tables are fine.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusmill.llm.common import ascii_lower, row_key, settled, stored

#: Fixed value of the contract: what a word is, after lower-casing A-Z.
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Rows of the lookup table (about 300 bytes each) that are broadcast at once.
MOST_LOOKUPS = 200_000


def words_of(text: Column) -> Column:
    return F.regexp_extract_all(ascii_lower(F.coalesce(text, F.lit(""))), F.lit(WORD), 0)


def positional_index(docs: DataFrame) -> DataFrame:
    """(doc_id, row_key, doc, n_words, terms) of each row of ``docs``: the posting of the term ``terms[i]``
    is at position i. ``doc`` tells rows with equal ids apart."""
    terms = F.transform(words_of(F.col("text")), lambda w: F.xxhash64(w))
    rows = docs.select("doc_id", row_key().alias("row_key"), F.monotonically_increasing_id().alias("doc"), terms.alias("terms"))
    return stored(rows.select("doc_id", "row_key", "doc", F.size("terms").cast("long").alias("n_words"), "terms"), "postings")


def lookups(items: DataFrame, index: DataFrame, window: int, near_share: float) -> DataFrame:
    """(term, item, span, need, behind, around): by which terms the windows of ``items`` (item, words)
    are looked up. ``around`` has the words of the windows that are looked up by one place of an item,
    which is ``behind`` words after its first; ``need`` is the fewest different ones of a match."""
    whole = (
        items.select("item", F.transform("words", lambda w: F.xxhash64(w)).alias("item_terms"))
        .withColumns({"key": F.xxhash64("item", "item_terms"), "span": F.least(F.lit(window), F.size("item_terms"))})
    )
    terms = stored(whole.select(F.explode("item_terms").alias("term")).distinct(), "terms")
    few = F.broadcast(terms) if terms.count() <= 10 * MOST_LOOKUPS else terms
    frequency = stored(index.select(F.explode("terms").alias("term")).join(few, "term").groupBy("term").agg(F.count("*").alias("df")), "frequency")
    placed = whole.select("key", "item", "span", F.size("item_terms").alias("n"), F.posexplode("item_terms").alias("at", "term"))
    ahead = Window.partitionBy("key").orderBy("at").rowsBetween(0, window - 1)
    rarest = (
        placed.join(frequency, "term", "left")
        .withColumn("places", F.collect_list(F.struct("term", "at")).over(ahead))
        .withColumn("ranked", F.array_sort(F.collect_set(F.struct(F.coalesce("df", F.lit(0)).alias("df"), "term")).over(ahead)))
        .where(F.col("at") <= F.col("n") - F.col("span"))
        .withColumn("present", F.transform(F.filter("ranked", lambda r: r["df"] > 0), lambda r: r["term"]))
        .withColumn("need", F.ceil(near_share * F.size("ranked")).cast("int"))
        .where(F.size("present") >= F.col("need"))
        .groupBy("key", "item", F.col("places.term").alias("terms"))
        .agg(F.min(F.struct("at", "places", "present", "need")).alias("w"))
        .select("key", "item", "w.*", F.explode(F.slice("w.present", F.lit(1), F.size("w.present") - F.col("w.need") + 1)).alias("term"))
        .withColumn("place", F.array_min(F.transform(F.filter("places", lambda p: p["term"] == F.col("term")), lambda p: p["at"])))
        .groupBy("key", "item", "term", "place")
        .agg(F.min("need").alias("need"), F.min("at").alias("low"), F.max("at").alias("high"))
    )
    found = rarest.join(whole.select("key", "span", "item_terms"), "key").select(
        "term", "item", "span", "need", (F.col("place") - F.col("low")).alias("behind"),
        F.slice("item_terms", F.col("low") + 1, F.col("high") - F.col("low") + F.col("span")).alias("around"),
    )
    return stored(found, "lookups")


def matches(index: DataFrame, wanted: DataFrame, window: int, slack: int, near_share: float) -> DataFrame:
    """(doc, item, starts, span, near) of the places where a lookup's windows are met: the starts of exact
    ones, and whether there is a near one."""
    reach = window + 2 * slack - 1
    low = F.greatest(F.col("pos") - reach, F.lit(0))
    spread = index.select("doc", F.col("terms").alias("whole"), F.posexplode("terms").alias("pos", "term")).select(
        "doc", "term", "pos", low.alias("from"), F.slice("whole", low + 1, F.lit(2 * reach + 1)).alias("there")
    )
    blocks = max(1, math.ceil(2 * wanted.count() / MOST_LOOKUPS))
    block = F.pmod(F.xxhash64("term", "item", "behind", "around"), F.lit(blocks))
    found = [
        spread.join(F.broadcast(wanted.where(block == b)), "term").where(F.size(F.array_intersect("there", "around")) >= F.col("need")).drop("term")
        for b in range(blocks)
    ]
    at = stored(reduce(DataFrame.unionByName, found), "met")
    first = F.col("pos") - F.col("behind")
    own = F.sequence(F.lit(0), F.size("around") - F.col("span"))
    stretch = F.col("span") + 2 * slack

    def same(o: Column) -> Column:
        start = first + o - F.col("from")
        here = F.slice("there", F.greatest(start, F.lit(0)) + 1, F.col("span"))
        return (start >= 0) & (here == F.slice("around", o + 1, F.col("span")))

    def close(o: Column) -> Column:
        terms = F.array_distinct(F.slice("around", o + 1, F.col("span")))
        lows = F.sequence(F.greatest(F.col("pos") - stretch + 1, F.lit(0)), F.col("pos"))
        return F.exists(
            lows, lambda low: F.size(F.array_intersect(F.slice("there", low - F.col("from") + 1, stretch), terms)) >= F.ceil(near_share * F.size(terms))
        )

    starts = F.transform(F.filter(own, same), lambda o: first + o)
    return at.select("doc", "item", "span", starts.alias("starts"), F.exists(own, close).alias("near")).where("near OR size(starts) > 0")


def contaminated_documents(docs: DataFrame, items: DataFrame, window: int = 10, slack: int = 3, near_share: float = 0.8) -> DataFrame:
    """Hits of test windows in each document.

    ``items``: item_id, text. A window is ``window`` consecutive words of an item,
    or all of a shorter one. ``near_items`` counts items without an exact hit
    of which some window has at least ``near_share`` of its terms within as many
    consecutive words as it has itself and ``slack`` more on either side.
    """
    items = items.where("item_id IS NOT NULL").select(F.col("item_id").cast("string").alias("item"), words_of(F.col("text")).alias("words"))
    index = positional_index(docs.select(F.col("doc_id").cast("long"), "text"))
    wanted = lookups(items.where(F.size("words") > 0).distinct(), index, window, near_share)
    found = matches(index, wanted, window, slack, near_share)
    spans = F.transform("starts", lambda s: F.struct(s.alias("start"), F.col("span").alias("span")))
    by_item = found.groupBy("doc", "item").agg(F.array_distinct(F.flatten(F.collect_set(spans))).alias("spans"))
    covered = F.flatten(F.transform(F.flatten("spans"), lambda h: F.sequence(h["start"], h["start"] + h["span"] - 1)))
    hit_items = F.array_sort(F.transform(F.filter("matched", lambda m: F.size(m["spans"]) > 0), lambda m: m["item"]))
    by_doc = (
        by_item.groupBy("doc")
        .agg(F.collect_list(F.struct("item", "spans")).alias("matched"))
        .select("doc", F.size("matched").alias("n_matched"), hit_items.alias("found"), F.col("matched.spans").alias("spans"))
        .select("doc", "n_matched", "found", F.size(F.array_distinct(covered)).cast("long").alias("n_hit"))
    )
    none = F.lit(0).cast("long")
    n_items = F.coalesce(F.size("found").cast("long"), none)
    return (
        index.select("doc_id", "row_key", "doc", "n_words")
        .join(by_doc, "doc", "left")
        .select(
            "doc_id",
            "n_words",
            F.coalesce("n_hit", none).alias("n_hit"),
            F.when(F.col("found").isNull(), none).otherwise(n_items).alias("n_items"),
            F.sha2(F.coalesce(F.array_join("found", ","), F.lit("")), 256).alias("items_sha256"),
            F.coalesce(F.col("n_hit") > 0, F.lit(False)).alias("contaminated"),
            F.when(F.col("found").isNull(), none).otherwise(F.col("n_matched") - F.size("found")).alias("near_items"),
            "row_key",
        )
    )


def without_contaminated(docs: DataFrame, items: DataFrame) -> DataFrame:
    """The rows of ``docs`` without a hit, each judged by its own text."""
    hits = settled(
        docs.sparkSession, "hits", lambda: contaminated_documents(docs, items).where("contaminated").select(F.col("row_key").alias("_key")).distinct()
    )
    return docs.withColumn("_key", row_key()).join(hits, "_key", "left_anti").select(docs.columns)
