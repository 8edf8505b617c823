"""Ranked lexical search by Block-Max WAND over an index of shards.

``build_index`` deals documents to shards of bounded size, one after the other in each task.
A shard holds, for every term, posting blocks of ``BLOCK`` documents: gaps and counts packed
in the narrowest of one, two, four or eight bytes, with the block's first and last document and its
greatest impact. ``search`` reads the blocks of the asked terms alone, brings each shard
together and goes through it per query: lists ordered by where they stand give the pivot, the
first document that their greatest impacts can lift to the threshold; shallow moves of the block
pointers over the next ``STRETCH`` documents give for each the sum of the maxima of the blocks that
lie on it; blocks on which no document reaches the threshold stay packed, the others
are unpacked and scored. The threshold is the ``k``-th score so far in the task, over all its shards. Ties at the threshold are kept, so
the result is that of scoring every document.

Terms are runs of ASCII letters and digits and of characters beyond ASCII, A-Z lower-cased.
A term's weight is floor(1000 ln((2 N + 2) / (2 df + 1))); all else is in integers.

Shuffled are the asked terms' blocks, by shard, and ``k`` rows a query and task. Queries go
in sets of at most ``QUERIES`` rows and ``QUERY_TERMS`` terms; each set is read against the
index, and its terms, bounded in this way, are broadcast.

Defined cases: a null or empty text has no terms: such a document is found by nothing and not
counted in N, such a query finds nothing; repeated rows are documents and queries of their
own; a null ``doc_id`` ranks behind all others of the same score; a null ``item_id`` is answered
like any other; a very long text is taken whole, as a shard of its own if need be; other
columns are ignored; empty tables give an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpusmill.llm.common import stored

BLOCK = 128
#: A shard is closed at so many documents or bytes of text.
SHARD_DOCS, SHARD_BYTES = 32_768, 48_000_000
#: Documents that one step of a search looks at.
STRETCH = 2048
QUERIES, QUERY_TERMS = 1000, 100_000
#: Bytes that belong to terms: digits, letters (lower-cased) and all beyond ASCII; others part them.
TABLE = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
BLOCKS = "shard long, term string, block int, n int, impact long, first int, last int, gaps binary, counts binary"
NAMES = [c.split()[0] for c in BLOCKS.split(", ")]
WIDTHS = {1: np.uint8, 2: np.uint16, 4: np.uint32, 8: np.uint64}
NO_ID = np.iinfo(np.int64).max


def terms_of(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").translate(TABLE).split()


@dataclass(frozen=True)
class Index:
    """``blocks``: the posting blocks, and with an empty term one row a shard with its documents' ids
    and lengths; ``documents`` and ``terms``: N and L."""

    blocks: DataFrame
    documents: int
    terms: int


def packed(values: np.ndarray) -> bytes:
    """In the narrowest width that holds all."""
    top = int(values.max())
    width = 1 if top < 1 << 8 else 2 if top < 1 << 16 else 4 if top < 1 << 32 else 8
    return values.astype(WIDTHS[width]).tobytes()


def unpacked(raw: bytes, n: int) -> np.ndarray:
    return np.frombuffer(raw, WIDTHS[len(raw) // n]).astype(np.int64)


def length_term(lengths: list[int], documents: int, terms: int) -> np.ndarray:
    return np.array([50 + 50 * n * documents // terms for n in lengths], np.int64)


def impacts(counts: np.ndarray, m: np.ndarray) -> np.ndarray:
    return 1_000_000_000 * counts // (1000 * counts + 20 * m)


class Vocabulary(dict):
    """Numbers for words, in the order in which they are met."""

    def __missing__(self, word: bytes) -> int:
        value = self[word] = len(self)
        return value


class ShardWriter:
    """Postings of the documents of one shard, in memory until they are packed."""

    def __init__(self, shard: int):
        self.shard, self.vocabulary, self.bytes = shard, Vocabulary(), 0
        self.ids, self.lengths, self.words = [], [], []

    def add(self, doc_id: int | None, words: list[bytes], size: int) -> None:
        self.words.append(np.fromiter(map(self.vocabulary.__getitem__, words), np.int64, len(words)))
        self.ids.append(NO_ID if doc_id is None else doc_id)
        self.lengths.append(len(words))
        self.bytes += size

    @property
    def full(self) -> bool:
        return len(self.ids) >= SHARD_DOCS or self.bytes >= SHARD_BYTES

    def blocks(self, documents: int, terms: int) -> Iterator[pa.RecordBatch]:
        m = length_term(self.lengths, documents, terms)
        docs = np.repeat(np.arange(len(self.ids)), self.lengths)
        postings, counts = np.unique(np.concatenate(self.words) * SHARD_DOCS + docs, return_counts=True)
        term, doc = np.divmod(postings, SHARD_DOCS)
        impact = impacts(counts.astype(np.int64), m[doc])
        heads = np.flatnonzero(np.diff(term, prepend=-1))
        place = np.arange(len(term)) - np.repeat(heads, np.diff(heads, append=len(term)))
        starts = np.flatnonzero(place % BLOCK == 0)
        ends = np.append(starts[1:], len(term))
        names = [w.decode("utf-8", "surrogatepass") for w in self.vocabulary]
        own = [(self.shard, "", 0, len(self.ids), 0, 0, len(self.ids) - 1, np.array(self.ids, np.int64).tobytes(), m.tobytes())]
        tops = np.maximum.reduceat(impact, starts)
        gap = np.diff(doc, prepend=0)
        gap[starts] = 0
        wide = np.maximum(np.maximum.reduceat(gap, starts), np.maximum.reduceat(counts, starts)) > 255
        gaps, freqs = gap.astype(np.uint8).tobytes(), counts.astype(np.uint8).tobytes()
        rows = (
            (self.shard, names[t], i, b - a, top, x, y, packed(gap[a:b]) if w else gaps[a:b], packed(counts[a:b]) if w else freqs[a:b])
            for a, b, t, i, top, x, y, w in zip(
                *(c.tolist() for c in (starts, ends, term[starts], place[starts] // BLOCK, tops, doc[starts], doc[ends - 1], wide)), strict=True
            )
        )
        yield batch_of(own)
        while held := list(islice(rows, 20_000)):
            yield batch_of(held)


TYPES = [pa.int64(), pa.string(), pa.int32(), pa.int32(), pa.int64(), pa.int32(), pa.int32(), pa.binary(), pa.binary()]


def batch_of(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), TYPES, strict=True)], names=NAMES)


def corpus_size(docs: DataFrame) -> tuple[int, int]:
    """N and L: documents with a term, and terms with repeats."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        documents = terms = 0
        for batch in batches:
            for text in batch.column(0):
                n = len(terms_of(text.as_py()))
                documents, terms = documents + (n > 0), terms + n
        yield pa.RecordBatch.from_arrays([pa.array([documents]), pa.array([terms])], names=["documents", "terms"])

    row = docs.select("text").mapInArrow(run, "documents long, terms long").agg(F.sum("documents"), F.sum("terms")).first()
    return row[0] or 0, row[1] or 0


def build_index(docs: DataFrame) -> Index:
    """The index of (doc_id, text), stored in the shared folder."""
    documents, terms = corpus_size(docs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = TaskContext.get().partitionId() << 32
        shard = ShardWriter(first)
        for batch in batches:
            for doc_id, text in zip(batch.column(0), batch.column(1), strict=True):
                text = text.as_py()
                if words := terms_of(text):
                    shard.add(doc_id.as_py(), words, len(text))
                    if shard.full:
                        yield from shard.blocks(documents, terms)
                        shard = ShardWriter(shard.shard + 1)
        if shard.ids:
            yield from shard.blocks(documents, terms)

    blocks = docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, BLOCKS)
    return Index(stored(blocks, "index"), documents, terms)


class PostingList:
    """One term of one shard. Blocks are unpacked when first scored."""

    def __init__(self, rows: list[tuple[int, int, int, int, bytes, bytes]]):
        n, impact, first, last, self.gaps, self.counts = zip(*rows, strict=True)
        self.n, self.impact, self.first, self.last = (np.array(c, np.int64) for c in (n, impact, first, last))
        self.top, self.open = int(self.impact.max()), {}

    def block(self, at: int, m: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Documents and impacts."""
        if at not in self.open:
            n = int(self.n[at])
            docs = self.first[at] + np.cumsum(unpacked(self.gaps[at], n))
            self.open[at] = docs, impacts(unpacked(self.counts[at], n), m[docs])
        return self.open[at]


class Best:
    """The best ``k`` (score, doc_id) so far; smaller ids first among equal scores."""

    def __init__(self, k: int):
        self.k, self.least = k, 1
        self.scores, self.ids = np.zeros(0, np.int64), np.zeros(0, np.int64)

    def add(self, scores: np.ndarray, ids: np.ndarray) -> None:
        scores, ids = np.append(self.scores, scores), np.append(self.ids, ids)
        order = np.lexsort((ids, -scores))[: self.k]
        self.scores, self.ids = scores[order], ids[order]
        if len(order) == self.k:
            self.least = max(1, int(self.scores[-1]))


def search_shard(lists: list[tuple[int, PostingList]], ids: np.ndarray, m: np.ndarray, best: Best) -> None:
    """Block-Max WAND over the (weight, list) pairs of one query, a stretch of documents at a time."""
    lists = sorted(((w, p) for w, p in lists if w > 0), key=lambda x: -x[0] * x[1].top)
    at = 0
    while at < len(ids):
        ahead = [(w, p, b) for w, p in lists if (b := int(p.last.searchsorted(at))) < len(p.last)]
        standing = sorted((max(at, int(p.first[b])), w * p.top) for w, p, b in ahead)
        bound, pivot = 0, None
        for doc, most in standing:
            bound += most
            if bound >= best.least:
                pivot = doc
                break
        if pivot is None:
            return
        end = min(len(ids), pivot + STRETCH)
        # shallow moves: the blocks that lie on each document of the stretch, by their bounds alone
        steps, near = np.zeros(end - pivot + 1, np.int64), []
        for w, p, b in ahead:
            e = int(p.first.searchsorted(end))
            b += int(p.last[b:e].searchsorted(pivot))
            if b < e:
                lo, hi = np.maximum(p.first[b:e], pivot) - pivot, np.minimum(p.last[b:e] + 1, end) - pivot
                steps[lo] += w * p.impact[b:e]
                near.append((w, p, b, lo, hi))
        for w, p, b, _, hi in near:
            steps[hi] -= w * p.impact[b : b + len(hi)]
        live = np.cumsum(np.cumsum(steps[:-1]) >= best.least)
        if live[-1]:
            live = np.append(0, live)
            scores = np.zeros(end - pivot, np.int64)
            for w, p, b, lo, hi in near:
                for k in np.flatnonzero(live[hi] > live[lo]).tolist():
                    docs, impact = p.block(b + k, m)
                    i, j = docs.searchsorted((pivot, end)) if docs[0] < pivot or docs[-1] >= end else (0, len(docs))
                    scores[docs[i:j] - pivot] += w * impact[i:j]
            good = np.flatnonzero(scores >= best.least)
            if len(good):
                best.add(scores[good], ids[pivot + good])
        at = end


def found_in(blocks: DataFrame, queries: list[tuple[int, list[tuple[str, int]]]], k: int) -> DataFrame:
    """(query, doc_id, score): the best ``k`` of each task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = [Best(k) for _ in queries]
        now, rows, ids, m = None, {}, None, None

        def close() -> None:
            if now is not None:
                lists = {t: PostingList(r) for t, r in rows.items()}
                for (_, terms), b in zip(queries, best, strict=True):
                    search_shard([(w, lists[t]) for t, w in terms if t in lists], ids, m, b)

        for batch in batches:
            for shard, term, _, n, impact, first, last, gaps, counts in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if shard != now:
                    close()
                    now, rows = shard, {}
                if term == "":
                    ids, m = np.frombuffer(gaps, np.int64), np.frombuffer(counts, np.int64)
                else:
                    rows.setdefault(term, []).append((n, impact, first, last, gaps, counts))
        close()
        for (q, _), b in zip(queries, best, strict=True):
            if len(b.ids):
                found = pa.array(b.ids, mask=b.ids == NO_ID)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(b.ids), q, np.int64)), found, pa.array(b.scores)], names=["query", "doc_id", "score"])

    parts = blocks.repartition("shard").sortWithinPartitions("shard", "term", "block")
    return parts.mapInArrow(run, "query long, doc_id long, score long")


def query_sets(asked: DataFrame) -> Iterator[list[tuple[int, list[str]]]]:
    """(query, terms) in sets of bounded size."""
    held, size = [], 0
    for row in asked.toLocalIterator(prefetchPartitions=True):
        if held and (len(held) >= QUERIES or size + len(row.terms) > QUERY_TERMS):
            yield held
            held, size = [], 0
        held.append((row.query, row.terms))
        size += len(row.terms)
    if held:
        yield held


def search(index: Index, queries: DataFrame, k: int = 50) -> DataFrame:
    """(item_id, rank, doc_id, score): the ``k`` best documents for each row of (item_id, text)."""
    spark = queries.sparkSession

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            terms = [sorted({w.decode("utf-8", "surrogatepass") for w in terms_of(t)}) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(terms, pa.list_(pa.string()))], names=["query", "terms"])

    rows = stored(queries.select("item_id", "text").withColumn("query", F.monotonically_increasing_id()), "queries")
    asked = stored(rows.select("query", "text").mapInArrow(run, "query long, terms array<string>"), "asked")
    parts = []
    for held in query_sets(asked.where("size(terms) > 0")):
        wanted = asked.where(F.col("query").isin([q for q, _ in held])).select(F.explode("terms").alias("term")).distinct()
        blocks = stored(index.blocks.join(F.broadcast(wanted.union(spark.sql("SELECT ''"))), "term").select(NAMES), "wanted")
        df = dict(blocks.where("term <> ''").groupBy("term").agg(F.sum("n")).collect())
        weight = {t: math.floor(1000 * math.log((2 * index.documents + 2) / (2 * n + 1))) for t, n in df.items()}
        parts.append(stored(found_in(blocks, [(q, [(t, weight[t]) for t in terms if t in weight]) for q, terms in held], k), "found"))
    if not parts:
        return rows.limit(0).selectExpr("item_id", "1 rank", "0L doc_id", "0L score")
    every = parts[0]
    for part in parts[1:]:
        every = every.union(part)
    order = Window.partitionBy("query").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    best = every.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return best.join(rows.select("query", "item_id"), "query").select("item_id", "rank", "doc_id", "score")


RANKED_SQL = r"""
WITH docs AS (SELECT row_number() OVER () AS row, doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS words FROM documents),
size AS (SELECT count(*) AS nd, sum(len(words))::BIGINT AS nl FROM docs WHERE len(words) > 0),
tf AS (SELECT row, term, count(*) AS tf FROM (SELECT row, unnest(words) AS term FROM docs) GROUP BY row, term),
weights AS (SELECT term, floor(1000 * ln((2 * any_value(nd) + 2) / (2 * count(*) + 1)))::BIGINT AS w FROM tf, size GROUP BY term),
lengths AS (SELECT row, doc_id, 50 + (50 * len(words) * nd) // nl AS m FROM docs, size WHERE len(words) > 0),
items AS (SELECT row_number() OVER () AS query, item_id, list_distinct(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS words FROM benchmark),
asked AS (SELECT query, item_id, unnest(words) AS term FROM items),
scores AS (
  SELECT query, any_value(item_id) AS item_id, row, any_value(doc_id) AS doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 20 * m)))::BIGINT AS score
  FROM asked JOIN tf USING (term) JOIN weights USING (term) JOIN lengths USING (row) GROUP BY query, row
), ranked AS (SELECT item_id, row_number() OVER (PARTITION BY query ORDER BY score DESC, doc_id)::INTEGER AS rank, doc_id, score FROM scores WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM ranked WHERE rank <= 50
"""
