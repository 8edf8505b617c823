"""MinHash near-duplicates by a signature-coordinate inverted join.

Each distinct shingle set posts its id under every (coordinate, value) of its MinHash
signature. Two sets whose signatures agree in at least ``matches`` of ``coordinates``
places share one of the first ``coordinates - matches + 1`` lists of either, whatever
common order the lists have; ordered by length, only the shortest are merged (the
prefix) and the long ones skipped. A set with fewer than ``matches`` lists that it
shares with another is dropped at once. Collisions of the proposed pairs are counted
over the whole signatures, pairs above the match threshold are verified on the full
sets, and links close to components (``simjoin``, ``components``).

The match threshold is the highest that misses a pair at the similarity threshold with a
probability of at most 2e-6 (28 of 48 for a Jaccard of 0.85); pairs above it are missed less.

Defined cases: a null, empty or blank text has an empty set, no link and itself as
component; texts with equal sets are one class, linked with each other; a row with a
null ``doc_id`` belongs to its group but names no component: its ``component_id`` is null and
it is kept (``deduplicated`` keeps one row of a group whatever their ids are); repeated
rows each get a row; rows that repeat a ``doc_id`` are judged by their own texts; a very
long text is one set, taken whole; other columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusmill.llm.common import row_key, settled, stored
from corpusmill.llm.shingles import WordHashes, permutations, set_key, shingle_set, signature, words_of
from corpusmill.llm.simjoin import linked, parity_sketch, shared_lists, with_centres

COORDINATES, MISS = 48, 2e-6


def fewest_matches(coordinates: int, percent: int, miss: float = MISS) -> int:
    """The highest match threshold that a pair at the similarity misses with at most
    the given probability."""
    t, total = percent / 100, 0.0
    for m in range(coordinates):
        total += math.comb(coordinates, m) * t**m * (1 - t) ** (coordinates - m)
        if total > miss:
            return max(m, 1)
    return coordinates


PROFILE = "doc_id long, row_key long, n long, set_key string, signature array<int>, sketch array<long>"


def profiles(docs: DataFrame, size: int, coordinates: int) -> DataFrame:
    """Set size, set key, signature and parity sketch of each document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        a, b = permutations(coordinates)
        for batch in batches:
            n, keys, signatures, sketches = [], [], [], []
            for text in batch.column(2).to_pylist():
                items = shingle_set(hashes.of(words_of(text or "")), size)
                n.append(len(items))
                keys.append(set_key(items))
                signatures.append((signature(items, a, b) >> np.uint64(32)).astype(np.uint32).view(np.int32) if len(items) else None)
                sketches.append(parity_sketch(items) if len(items) else None)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(n, pa.int64()), pa.array(keys), pa.array(signatures, pa.list_(pa.int32())), pa.array(sketches, pa.list_(pa.int64()))],
                names=["doc_id", "row_key", "n", "set_key", "signature", "sketch"],
            )

    return docs.select("doc_id", "row_key", "text").mapInArrow(run, PROFILE)


def full_sets(texts: DataFrame, size: int) -> DataFrame:
    """(id, n, items) of texts (id, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                sets = [shingle_set(hashes.of(words_of(t or "")), size).view(np.int64) for t in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array([len(s) for s in sets], pa.int64()), pa.array(sets, pa.list_(pa.int64()))],
                    names=["id", "n", "items"],
                )

    return texts.select("id", "text").mapInArrow(run, "id long, n long, items array<long>")


RESULT = ["doc_id", "n_shingles", "component_id", "kept", "row_key", "group_id"]


def near_duplicates(docs: DataFrame, shingle: int = 5, percent: int = 80, coordinates: int = COORDINATES) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept, row_key, group_id) for each document of (doc_id, text).

    ``row_key`` is a hash of id and text; ``group_id`` tells components apart, those of rows
    without an id among them, and is null for an empty set."""
    matches = fewest_matches(coordinates, percent)
    docs = docs.select(F.col("doc_id").cast("long"), "text").withColumn("row_key", row_key())
    found = stored(profiles(docs, shingle, coordinates), "profiles")
    place = F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "row_key")
    classes = stored(
        found.where("n > 0")
        .groupBy("set_key")
        .agg(F.min(place).alias("first"), F.first("n").alias("n"), F.first("signature").alias("signature"), F.first("sketch").alias("sketch"))
        .withColumn("id", F.monotonically_increasing_id()),
        "classes",
    )
    postings = classes.select("id", F.posexplode("signature").alias("i", "v")).select(
        "id", (F.shiftleft(F.col("i").cast("long"), 32) + F.col("v").cast("long").bitwiseAND(0xFFFFFFFF)).alias("key")
    )
    prefix = F.slice("lists", 1, F.size("lists") - matches + 1)
    short_first = (
        shared_lists(postings).where(F.size("lists") >= matches).select("id", "weight", F.explode(prefix).alias("list")).select("list.key", "id", "weight")
    )
    collisions = F.size(F.filter(F.zip_with("x.signature", "y.signature", lambda p, q: p == q), lambda same: same))
    lists = stored(with_centres(stored(short_first, "prefix-lists")), "lists")
    wanted = lists.select("id").distinct().join(classes.select("id", "first.row_key"), "id")
    sets = stored(full_sets(docs.join(wanted, "row_key"), shingle).dropDuplicates(["id"]), "sets")
    profile = classes.select("id", "n", "sketch", "signature")
    _, components = linked(lists, profile, sets, percent, collisions >= matches)
    grouped = classes.select("set_key", "id", "first").join(components, "id", "left").withColumn("group_id", F.coalesce("component", "id"))
    least = grouped.groupBy("group_id").agg(F.min("first.doc_id").alias("component_id"))
    named = grouped.select("set_key", "group_id").join(least, "group_id")
    return (
        found.select("doc_id", "row_key", F.col("n").alias("n_shingles"), "set_key")
        .join(named, "set_key", "left")
        .withColumn("component_id", F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id")))
        .withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))
        .select(RESULT)
    )


def deduplicated(docs: DataFrame, shingle: int = 5, percent: int = 80) -> DataFrame:
    """The columns of ``docs``, with one row of each group of near copies: that with the lowest
    id, and of repeated rows one. Rows without words are linked with nothing and all stay."""

    def chosen() -> DataFrame:
        judged = near_duplicates(docs, shingle, percent)
        place = F.struct(F.col("doc_id").isNull(), "doc_id", "row_key")
        heads = judged.where("group_id IS NOT NULL").groupBy("group_id").agg(F.min_by("row_key", place).alias("row_key")).select("row_key")
        return judged.where("group_id IS NULL").select("row_key").distinct().withColumn("every", F.lit(True)).unionByName(heads.withColumn("every", F.lit(False)))

    stay = settled(docs.sparkSession, "stay", chosen)
    rows = docs.withColumn("_key", row_key()).join(stay.select(F.col("row_key").alias("_key"), F.col("every").alias("_every")), "_key")
    copies = rows.where("NOT _every").dropDuplicates(["_key"])
    return copies.select(docs.columns).unionByName(rows.where("_every").select(docs.columns))
