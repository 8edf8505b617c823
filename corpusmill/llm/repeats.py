"""Repeated passages by MinHash banding of paragraphs, and exact runs inside them.

A paragraph is a line of at least ``min_words`` words; shorter lines (headings,
greetings, single words) repeat in clean texts too and are left alone. Paragraphs
with equal words are one class. Classes that collide in a band of their MinHash are
joined through ``simjoin``, verified by the exact Jaccard of their shingle sets and
closed to components; of each component the first paragraph, by document and place,
stays and all others are removed. The bands are tuned for recall: as few as find a
pair at the threshold with probability ``recall``, of rows enough that unlike
paragraphs seldom meet.

A passage may also stand inside a longer paragraph. So texts are cut as well into
segments at places that depend on a few words around them alone; a passage gives the
same segments wherever it stands. Neighbouring segments that each occur elsewhere form
a run, and runs of at least ``min_run`` words are repeated passages. Each exact passage
of 50 words and more has such a run; a line of common words has none.

Defined cases: a null or empty text has no paragraphs; paragraphs repeated within a
document count as repeats; so do repeated rows (equal in id and text), which stay or go together; rows that
repeat a ``doc_id`` are judged by their own texts; rows with a null ``doc_id`` count as any other and
come last in the order; a very long text is cut like any other, whole; other columns are ignored; an empty table
gives an empty result. Classes are named by
64-bit hashes of their words.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusmill.llm.common import discard, row_key, stored
from corpusmill.llm.shingles import MIX, WordHashes, mixed, permutations, shingle_set
from corpusmill.llm.simjoin import linked, parity_sketch, shared_lists, with_centres

MIN_WORDS, MIN_RUN = 20, 20
REACH = 7
#: Documents are hashed together up to so many words.
GROUP_WORDS = 1 << 16
WIDE = 1 << 14


def segment_starts(words: np.ndarray, reach: int = REACH) -> np.ndarray:
    """Places whose word pair hashes lowest in some window of ``2 * reach - 1`` places, so
    no window is without one; of equal ones the last."""
    width = 2 * reach - 1
    if len(words) < width + 1:
        return np.zeros(0, np.int64)
    least = mixed(words[:-1] * MIX[3] + words[1:])
    at, reach = np.arange(len(least)), 1
    while reach < width:  # windows of twice the size from two neighbours, at last overlapping ones
        step = min(reach, width - reach)
        left, right = least[:-step], least[step:]
        at, least, reach = np.where(right <= left, at[step:], at[:-step]), np.minimum(left, right), reach + step
    return at[np.flatnonzero(np.diff(at, prepend=-1))]


def run_hashes(words: np.ndarray, begins: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A hash of the words of each run."""
    size = ends - begins
    at = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
    own = mixed(words[np.repeat(begins, size) + at] + at.astype(np.uint64) * MIX[0])
    return mixed(np.add.reduceat(own, np.cumsum(size) - size) + size.astype(np.uint64)).view(np.int64)


def tuned_bands(threshold: float, recall: float = 0.995, unlike: float = 0.2, collisions: float = 0.02) -> tuple[int, int]:
    """(bands, rows): the fewest bands that reach ``recall`` at ``threshold`` and let
    pairs with a Jaccard of ``unlike`` collide with at most the given probability."""
    for rows in range(1, 33):
        bands = math.ceil(math.log(1 - recall) / math.log(1 - threshold**rows))
        if 1 - (1 - unlike**rows) ** bands <= collisions:
            return bands, rows
    raise ValueError("no bands reach these rates")


def reduced(h: np.ndarray, starts: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Least value of each permutation in each run of ``h`` that begins at ``starts``."""
    if len(h) <= WIDE:
        return np.minimum.reduceat(h[None, :] * a + b, starts, axis=1)
    return np.stack([np.minimum.reduceat(h * x + y, starts) for x, y in zip(a[:, 0], b[:, 0], strict=True)])


def paragraph_hashes(words: np.ndarray, begins: np.ndarray, ends: np.ndarray, shingle: int, a: np.ndarray, b: np.ndarray, rows: int) -> tuple[np.ndarray, np.ndarray]:
    """(ids, bands): a hash of each paragraph's words, and its band keys."""
    n = len(words)
    size = ends - begins
    h = np.full(n - shingle + 1, shingle, np.uint64)
    for i in range(shingle):
        h = mixed(h * MIX[i] + words[i : n - shingle + 1 + i])
    inner = size - shingle + 1
    starts = np.cumsum(inner) - inner
    pick = np.repeat(begins - starts, inner) + np.arange(inner.sum())
    signature = reduced(h[pick], starts, a, b).reshape(-1, rows, len(begins))
    keys = np.repeat(np.arange(len(signature), dtype=np.uint64)[:, None], len(begins), axis=1)
    for r in range(rows):
        keys = mixed(keys * MIX[1] + signature[:, r])
    return run_hashes(words, begins, ends), keys.T.view(np.int64)


def document_words(text: str, hashes: WordHashes) -> tuple[np.ndarray, np.ndarray]:
    """(hashes of all words, number of words of each line)."""
    lines = [line.split() for line in text.encode("utf-8", "surrogatepass").lower().split(b"\n")]
    return hashes.of([w for line in lines for w in line]), np.array([len(line) for line in lines])


UNITS = "row long, row_key long, doc_id long, paragraph int, start int, n_words int, id long, bands array<long>"


def units(docs: DataFrame, shingle: int, min_words: int, bands: int, rows: int) -> DataFrame:
    """One row for each paragraph (with its line number and band keys) and each segment
    (without) of each document (row_key, doc_id, text); ``row`` tells repeated rows apart."""

    a, b = permutations(bands * rows)

    def of_group(part: pa.RecordBatch, held: list[tuple]) -> Iterator[pa.RecordBatch]:
        words = np.concatenate([own for _, own, _ in held])
        whole: list[tuple] = []
        cut: list[tuple] = []
        first = 0
        for at, own, size in held:
            number = np.flatnonzero(size >= min_words)
            if len(number):
                ends = np.cumsum(size)[number]
                whole.append((np.full(len(number), at), number, ends - size[number], size[number], np.full(len(number), first)))
            cuts = segment_starts(own)
            if len(cuts) > 1:
                cut.append((np.full(len(cuts) - 1, at), cuts[:-1], np.diff(cuts), np.full(len(cuts) - 1, first)))
            first += len(own)
        if whole:
            at, number, begins, size, first = map(np.concatenate, zip(*whole, strict=True))
            ids, keys = paragraph_hashes(words, begins + first, begins + first + size, shingle, a, b, rows)
            lists = pa.ListArray.from_arrays(np.arange(0, keys.size + 1, bands, dtype=np.int32), pa.array(keys.ravel()))
            yield batch_of(part, at, pa.array(number, pa.int32()), begins, size, ids, lists)
        if cut:
            at, begins, size, first = map(np.concatenate, zip(*cut, strict=True))
            ids = run_hashes(words, begins + first, begins + first + size)
            yield batch_of(part, at, pa.nulls(len(ids), pa.int32()), begins, size, ids, pa.nulls(len(ids), pa.list_(pa.int64())))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for batch in batches:
            for part in (batch.slice(at, 256) for at in range(0, batch.num_rows, 256)):
                held, total = [], 0
                for at, text in enumerate(part.column(3).to_pylist()):
                    held.append((at, *document_words(text or "", hashes)))
                    total += len(held[-1][1])
                    if total >= GROUP_WORDS:
                        yield from of_group(part, held)
                        held, total = [], 0
                if held:
                    yield from of_group(part, held)

    def batch_of(part: pa.RecordBatch, at: np.ndarray, number: pa.Array, begins: np.ndarray, size: np.ndarray, ids: np.ndarray, lists: pa.Array) -> pa.RecordBatch:
        own = [part.column(i).take(pa.array(at)) for i in range(3)]
        arrays = [*own, number, pa.array(begins, pa.int32()), pa.array(size, pa.int32()), pa.array(ids), lists]
        return pa.RecordBatch.from_arrays(arrays, names=[c.split()[0] for c in UNITS.split(", ")])

    return docs.select(F.monotonically_increasing_id().alias("row"), "row_key", "doc_id", "text").mapInArrow(run, UNITS)


def paragraph_sets(wanted: DataFrame, shingle: int) -> DataFrame:
    """(id, n, items, sketch) of paragraphs (text, places: array of (paragraph, id))."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for batch in batches:
            for part in (batch.slice(at, 128) for at in range(0, batch.num_rows, 128)):
                ids, sets = [], []
                for text, places in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                    lines = text.encode("utf-8", "surrogatepass").lower().split(b"\n")
                    for place in places:
                        ids.append(place["id"])
                        sets.append(shingle_set(hashes.of(lines[place["paragraph"]].split()), shingle))
                arrays = [
                    pa.array(ids, pa.int64()),
                    pa.array([len(s) for s in sets], pa.int64()),
                    pa.array([s.view(np.int64) for s in sets], pa.list_(pa.int64())),
                    pa.array([parity_sketch(s) for s in sets], pa.list_(pa.int64())),
                ]
                yield pa.RecordBatch.from_arrays(arrays, names=["id", "n", "items", "sketch"])

    return wanted.select("text", "places").mapInArrow(run, "id long, n long, items array<long>, sketch array<long>")


def order_of(*place: str) -> Column:
    """Documents without an id come after all others."""
    return F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "row", *place)


def repeated_runs(segments: DataFrame, min_run: int) -> DataFrame:
    """Runs of neighbouring segments (row, row_key, doc_id, start, n_words, id) that all occur elsewhere."""
    # What is counted by id is stored before it is joined: then both sides of the joins are dealt anew, and Spark splits the
    # tasks of a segment that stands in a large share of the documents.
    again = stored(segments.groupBy("id").agg(F.count("*").alias("copies")).where("copies > 1").select("id"), "again")
    held = stored(segments.join(again, "id", "left_semi"), "shared-segments")
    first = stored(held.groupBy("id").agg(F.min(order_of("start", "row_key")).alias("first")), "first")
    shared = held.join(first, "id")
    w = Window.partitionBy("row").orderBy("start")
    follows = F.lag(F.col("start") + F.col("n_words")).over(w) == F.col("start")
    runs = shared.withColumn("run", F.sum((~F.coalesce(follows, F.lit(False))).cast("int")).over(w))
    other = (F.col("row_key") != F.col("first.row_key")) | (F.col("start") != F.col("first.start"))
    elsewhere = F.sum(F.when(other, F.col("n_words")).otherwise(0))
    found = stored(
        runs.groupBy("row", "doc_id", "run")
        .agg(F.min("start").alias("start"), F.sum("n_words").cast("int").alias("n_words"), F.min(F.struct("first", "id")).alias("m"), elsewhere.alias("elsewhere"))
        .where(F.col("n_words") >= min_run)
        .select(
            "doc_id", F.lit(None).cast("int").alias("paragraph"), "start", "n_words", F.col("m.id").alias("cluster_id"),
            F.col("m.first.doc_id").alias("first_doc_id"), F.col("m.first.start").alias("first_start"), (F.col("elsewhere") >= min_run).alias("removed"), "row",
        ),
        "runs",
    )
    discard(again, held, first)
    return found


def found_passages(docs: DataFrame, shingle: int, percent: int, min_words: int, recall: float, min_run: int) -> DataFrame:
    """The repeats of ``docs`` (row_key, doc_id, text), with the ``row`` they stand in."""
    bands, rows = tuned_bands(percent / 100, recall)
    cut = stored(units(docs, shingle, max(min_words, shingle), bands, rows), "units")
    runs = repeated_runs(cut.where("paragraph IS NULL").select("row", "row_key", "doc_id", "start", "n_words", "id"), min_run)
    found = cut.where("paragraph IS NOT NULL")
    classes = stored(
        found.groupBy("id").agg(F.count("*").alias("copies"), F.min(order_of("paragraph", "start", "row_key")).alias("first"), F.first("bands").alias("bands")),
        "classes",
    )
    postings = shared_lists(classes.select("id", F.explode("bands").alias("key")))
    lists = stored(with_centres(stored(postings.select("id", "weight", F.explode("lists.key").alias("key")), "postings")), "lists")
    places = (
        lists.select("id").distinct().join(classes.select("id", "first"), "id")
        .groupBy("first.row_key").agg(F.collect_list(F.struct("first.paragraph", "id")).alias("places"))
    )
    sets = stored(paragraph_sets(docs.join(places, "row_key"), shingle).dropDuplicates(["id"]), "sets")
    _, components = linked(lists, sets.select("id", "n", "sketch"), sets, percent)
    clusters = classes.select("id", "copies", "first").join(components, "id", "left").withColumn("cluster_id", F.coalesce("component", "id"))
    repeated = clusters.groupBy("cluster_id").agg(F.sum("copies").alias("copies"), F.min("first").alias("first")).where("copies > 1")
    named = clusters.select("id", "cluster_id").join(repeated, "cluster_id")
    paragraphs = found.select("row", "row_key", "doc_id", "paragraph", "start", "n_words", "id").join(named, "id").select(
        "doc_id", "paragraph", "start", "n_words", "cluster_id",
        F.col("first.doc_id").alias("first_doc_id"), F.col("first.start").alias("first_start"),
        ((F.col("row_key") != F.col("first.row_key")) | (F.col("paragraph") != F.col("first.paragraph"))).alias("removed"), "row",
    )
    return paragraphs.unionByName(runs)


def repeated_passages(
    docs: DataFrame, shingle: int = 5, percent: int = 80, min_words: int = MIN_WORDS, recall: float = 0.995, min_run: int = MIN_RUN
) -> DataFrame:
    """(doc_id, paragraph, start, n_words, cluster_id, first_doc_id, first_start, removed, method) for each
    paragraph that stands in a component with another one (``method`` is bands; ``paragraph`` is the number of its
    line, from 0), and for each run of repeated segments (``method`` is run; ``paragraph`` is null). ``start``
    counts the document's words. Of a cluster the first by document and place stays."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").select(row_key().alias("row_key"), "doc_id", "text")
    found = found_passages(docs, shingle, percent, min_words, recall, min_run)
    return found.drop("row").withColumn("method", F.when(F.col("paragraph").isNull(), "run").otherwise("bands"))


def without_repeats(docs: DataFrame, repeats: DataFrame) -> DataFrame:
    """(doc_id, text) with the words of removed paragraphs and runs taken out."""
    gone = repeats.where("removed").groupBy("doc_id").agg(F.collect_list(F.struct("start", "n_words")).alias("gone"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = []
            for text, spans in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                if spans and text:
                    dropped = {i for s in spans for i in range(s["start"], s["start"] + s["n_words"])}
                    pieces = re.findall(r"[^\x20\x09-\x0D]+[\x20\x09-\x0D]*|[\x20\x09-\x0D]+", text)
                    first = 1 if pieces[0][0] in " \t\n\r\x0b\x0c" else 0
                    text = "".join(p for i, p in enumerate(pieces) if i < first or i - first not in dropped)
                texts.append(text)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=["doc_id", "text"])

    return docs.select("doc_id", "text").join(gone, "doc_id", "left").mapInArrow(cut, "doc_id long, text string")
