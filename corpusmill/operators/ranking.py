"""Best documents of many questions by summed term weights: what a task holds is scored in it, and its best rows alone leave it.

Terms are 64-bit hashes of tokens."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusmill.functions.text import index_tokens
from corpusmill.session import stored

#: Terms of questions that go to the tasks at once, and sums and summands that one step of a task holds.
BLOCK_TERMS, SUMS = 500_000, 2_000_000
#: Stands for a document without an id, which comes last among equals.
NO_ID = 2**63 - 1


def hashed(tokens: Column) -> Column:
    return F.transform(tokens, lambda t: F.xxhash64(t))


def merged_terms(batches: Iterator[pa.RecordBatch], own: list[float], body: int) -> Iterator[pa.RecordBatch]:
    """(doc_id, terms, weights, content) of documents with the terms of each field, whose weights are ``own``: each term of a
    document once. ``body`` is the place of the field of the text."""
    for batch in batches:
        n, lists = batch.num_rows, batch.columns[1:]
        doc = np.concatenate([np.repeat(np.arange(n), c.value_lengths().to_numpy(zero_copy_only=False)) for c in lists])
        terms = np.concatenate([c.flatten().to_numpy(zero_copy_only=False) for c in lists])
        field = np.repeat(np.arange(len(lists)), [len(c.flatten()) for c in lists])
        order = np.lexsort((terms, doc))
        doc, terms, field = doc[order], terms[order], field[order]
        heads = np.flatnonzero(np.r_[True, (doc[1:] != doc[:-1]) | (terms[1:] != terms[:-1])][: len(doc)])
        weights, inside = np.array(own)[field], field == body
        if len(heads):
            weights, inside = np.add.reduceat(weights, heads), np.logical_or.reduceat(inside, heads)
        offsets = pa.array(np.r_[0, np.cumsum(np.bincount(doc[heads], minlength=n))].astype(np.int32))
        content = pa.array(np.ones(len(heads), np.float32), mask=~inside)
        columns = [pa.array(terms[heads]), pa.array(weights.astype(np.float32)), content]
        yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.ListArray.from_arrays(offsets, c) for c in columns)], names=["doc_id", "terms", "weights", "content"])


def document_terms(docs: DataFrame, fields: dict[str, float]) -> DataFrame:
    """(doc_id, terms, weights, content), stored: each document's terms, with the summed weights of the fields that hold one, and 1 where
    the field ``content`` does, else null. Rows are tokenized where they lie; only if an id has several rows they are brought together."""
    rows = docs.select("doc_id", *[hashed(index_tokens(F.col(f))).alias(f) for f in fields])
    if not docs.groupBy("doc_id").count().where("count > 1").isEmpty():
        rows = rows.groupBy("doc_id").agg(*[F.flatten(F.collect_list(f)).alias(f) for f in fields])
    own, body, kind = list(fields.values()), list(fields).index("content"), docs.schema["doc_id"].dataType.simpleString()
    merged = rows.mapInArrow(lambda batches: merged_terms(batches, own, body), f"doc_id {kind}, terms array<long>, weights array<float>, content array<float>")
    return stored(merged, "document-terms")


#: Bytes of identifiers, bytes that may stand between two of them, and lower case of A-Z; texts are cut into tokens about so many bytes at once.
WORD, JOINER = (np.isin(np.arange(256), np.frombuffer(b, np.uint8)) for b in (b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789_", b".:-"))
LOWER = np.frombuffer(bytes(range(256)).lower(), np.uint8)
STEP_BYTES = 1 << 22


def strings(sizes: np.ndarray, data: np.ndarray) -> pa.Array:
    offsets = np.r_[0, np.cumsum(sizes)].astype(np.int64)
    return pa.Array.from_buffers(pa.large_string(), len(sizes), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(data))])


def text_tokens(texts: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """(places of texts, tokens): what ``index_tokens`` gives for each text, with repeats, told apart by bytes."""
    texts = texts.cast(pa.large_string()).fill_null("")
    stops = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    raw = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[stops[0] : stops[-1]]
    stops = stops - stops[0]
    heads = stops[:-1][stops[:-1] < len(raw)]

    def beside(mask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The mask of the byte before and after each, within its text."""
        before, after = np.zeros(len(mask), bool), np.zeros(len(mask), bool)
        before[1:], after[:-1] = mask[:-1], mask[1:]
        before[heads], after[heads[heads > 0] - 1] = False, False
        return before, after

    word = WORD[raw]
    before, after = beside(word)
    held = word | (JOINER[raw] & before & after)
    before, after = beside(held)
    begins, ends = np.flatnonzero(held & ~before), np.flatnonzero(held & ~after) + 1
    places, found = [np.searchsorted(stops, begins, "right") - 1], [strings(ends - begins, LOWER[raw[held]])]
    files = pc.or_(pc.ends_with(found[0], ".md"), pc.ends_with(found[0], ".markdown"))
    if pc.any(files).as_py():
        places.append(places[0][files.to_numpy(zero_copy_only=False)])
        found.append(pc.replace_substring_regex(found[0].filter(files), r"\.(md|markdown)$", ""))
    at = np.flatnonzero((raw >= 0xE3) & (raw <= 0xEF))
    if len(at):
        code = (raw[at].astype(int) & 15) << 12 | (raw[at + 1].astype(int) & 63) << 6 | raw[at + 2] & 63
        at = at[((code >= 0x3400) & (code <= 0x4DBF)) | ((code >= 0x4E00) & (code <= 0x9FFF)) | ((code >= 0xF900) & (code <= 0xFAFF))]
        own = np.searchsorted(stops, at, "right") - 1
        two = np.flatnonzero((np.diff(at) == 3) & (np.diff(own) == 0))
        places += [own, own[two]]
        found += [strings(np.full(len(x), width), raw[x[:, None] + np.arange(width)].ravel()) for x, width in ((at, 3), (at[two], 6))]
    return np.concatenate(places), pa.concat_arrays(found)


def asked_in(batches: Iterator[pa.RecordBatch], own: list[float], body: int, asked: pa.Array, hashes: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Like ``merged_terms``, from the texts of the fields, for the tokens ``asked`` alone."""
    for whole in batches:
        size = sum(pc.binary_length(c).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64) for c in whole.columns[1:])
        edges = np.append(np.flatnonzero(np.diff(np.cumsum(size) // STEP_BYTES, prepend=-1)), len(size))
        for low, high in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
            batch = whole.slice(low, high - low)
            keys = []
            for field, texts in enumerate(batch.columns[1:]):
                doc, tokens = text_tokens(texts)
                at = pc.index_in(tokens, value_set=asked)
                some = at.is_valid().to_numpy(zero_copy_only=False)
                at = at.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)[some]
                keys.append((doc[some] * len(asked) + at) * len(own) + field)
            each = np.unique(np.concatenate(keys))
            pair, field = each // len(own), each % len(own)
            heads = np.flatnonzero(np.r_[True, pair[1:] != pair[:-1]][: len(pair)])
            weights, inside = np.array(own)[field], field == body
            if len(heads):
                weights, inside = np.add.reduceat(weights, heads), np.logical_or.reduceat(inside, heads)
            offsets = pa.array(np.r_[0, np.cumsum(np.bincount(pair[heads] // len(asked), minlength=len(batch)))].astype(np.int32))
            columns = [pa.array(hashes[pair[heads] % len(asked)]), pa.array(weights.astype(np.float32)), pa.array(np.ones(len(heads), np.float32), mask=~inside)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.ListArray.from_arrays(offsets, c) for c in columns)], names=["doc_id", "terms", "weights", "content"])


def asked_terms(docs: DataFrame, fields: dict[str, float], tokens: DataFrame) -> DataFrame:
    """``document_terms`` of which only the terms of questions ``tokens`` (query_id, token) are kept: the sums over them are the same.
    Where questions have none, or more than ``BLOCK_TERMS`` different ones, all terms are kept."""
    wanted = tokens.select("token", F.xxhash64("token").alias("term")).distinct().limit(BLOCK_TERMS + 1).collect()
    if not 0 < len(wanted) <= BLOCK_TERMS:
        return document_terms(docs, fields)
    asked, hashes = pa.array([r.token for r in wanted], pa.large_string()), np.array([r.term for r in wanted], np.int64)
    own, body, kind = list(fields.values()), list(fields).index("content"), docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, terms array<long>, weights array<float>, content array<float>"
    held = docs.select("doc_id", *fields).mapInArrow(lambda batches: asked_in(batches, own, body, asked, hashes), schema)
    held = stored(held, "asked-in-documents")
    if held.groupBy("doc_id").count().where("count > 1").isEmpty():
        return held
    each = held.select("doc_id", F.explode(F.arrays_zip("terms", "weights", "content")).alias("t"))
    once = each.groupBy("doc_id", F.col("t.terms").alias("term")).agg(F.sum("t.weights").cast("float").alias("weight"), F.max("t.content").alias("content"))
    lists = once.groupBy("doc_id").agg(F.collect_list(F.struct("term", "weight", "content")).alias("r"))
    return stored(lists.select("doc_id", F.col("r.term").alias("terms"), F.col("r.weight").alias("weights"), F.col("r.content").alias("content")), "asked-in-documents")


def by_document(posting: DataFrame) -> DataFrame:
    """(doc_id, terms, weights) of a posting (token, doc_id, weight)."""
    rows = posting.groupBy("doc_id").agg(F.collect_list(F.struct(F.xxhash64("token").alias("t"), F.col("weight").cast("float").alias("w"))).alias("r"))
    return rows.select("doc_id", F.col("r.t").alias("terms"), F.col("r.w").alias("weights"))


def term_frequency(terms: DataFrame) -> DataFrame:
    return terms.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count("*").alias("df"))


class Block:
    """Questions by their terms: ``vocabulary`` is sorted, and ``asking`` and ``weights`` from ``starts`` on belong to a term."""

    def __init__(self, rows: list):
        self.ids = [r.query_id for r in rows]
        terms = np.array([t for r in rows for t in r.terms], np.int64)
        asking = np.repeat(np.arange(len(rows)), [len(r.terms) for r in rows])
        order = np.argsort(terms, kind="stable")
        self.asking, self.weights, self.times = asking[order], np.array([w for r in rows for w in r.weights], float)[order], np.array([n for r in rows for n in r.times], float)[order]
        self.vocabulary, self.starts, self.counts = np.unique(terms[order], return_index=True, return_counts=True)


def blocks(asked: DataFrame) -> Iterator[Block]:
    own, size = [], 0
    for row in asked.toLocalIterator(prefetchPartitions=True):
        own.append(row)
        size += len(row.terms)
        if size >= BLOCK_TERMS:
            yield Block(own)
            own, size = [], 0
    if own:
        yield Block(own)


class Best:
    """The best ``k`` (score, matched, id) of each question so far: highest scores, then, with ``counted``, most terms, then the smaller id.
    Candidates are gathered and judged at once."""

    def __init__(self, n: int, k: int, counted: bool):
        self.k, self.counted = k, counted
        self.least, self.fewest, self.last = np.full(n, -np.inf), np.zeros(n), np.full(n, NO_ID)
        self.held = [np.zeros(0, np.int64), np.zeros(0), np.zeros(0), np.zeros(0, np.int64)]
        self.new: list[list[np.ndarray]] = []
        self.size = 0

    def add(self, q: np.ndarray, score: np.ndarray, matched: np.ndarray, ids: np.ndarray) -> None:
        least = self.least[q]
        equal = score == least
        ahead = equal & (ids < self.last[q])
        if self.counted:
            ahead = equal & ((matched > self.fewest[q]) | ((matched == self.fewest[q]) & (ids < self.last[q])))
        keep = (score > least) | ahead
        self.new.append([q[keep], score[keep], matched[keep], ids[keep]])
        self.size += int(keep.sum())
        if self.size >= max(SUMS // 4, len(self.held[0])):
            self.judge()

    def judge(self) -> None:
        q, score, matched, ids = (np.concatenate(c) for c in zip(self.held, *self.new, strict=True))
        order = np.lexsort((ids, -matched, -score, q) if self.counted else (ids, -score, q))
        q = q[order]
        heads = np.flatnonzero(np.r_[True, q[1:] != q[:-1]]) if len(q) else np.zeros(0, int)
        place = np.arange(len(q)) - np.repeat(heads, np.diff(np.r_[heads, len(q)]))
        order, q, place = order[place < self.k], q[place < self.k], place[place < self.k]
        self.held = [q, score[order], matched[order], ids[order]]
        full = place == self.k - 1
        self.least[q[full]], self.fewest[q[full]], self.last[q[full]] = self.held[1][full], self.held[2][full], self.held[3][full]
        self.new, self.size = [], 0


def score_batch(batch: pa.RecordBatch, block: Block, best: Best, decimals: int | None) -> None:
    """Adds the sums of a batch's documents, in steps of a bounded size."""
    n = len(block.ids)
    ids, lists = batch.column(0).to_numpy(), batch.column(1)
    terms = lists.flatten().to_numpy(zero_copy_only=False)
    weights = batch.column(2).flatten().to_numpy(zero_copy_only=False).astype(float)
    doc = np.repeat(np.arange(len(ids)), lists.value_lengths().to_numpy(zero_copy_only=False))
    at = np.minimum(np.searchsorted(block.vocabulary, terms), len(block.vocabulary) - 1)
    asked = (block.vocabulary[at] == terms) & ~np.isnan(weights)
    doc, at, weights = doc[asked], at[asked], weights[asked]
    counts = block.counts[at]
    room = np.cumsum(np.bincount(doc, counts, minlength=len(ids)))
    wide = max(1, SUMS // n)
    begin = 0
    while begin < len(ids):
        before = room[begin - 1] if begin else 0
        end = min(max(begin + 1, int(np.searchsorted(room, before + SUMS, "right"))), begin + wide, len(ids))
        a, b = np.searchsorted(doc, [begin, end])
        if a < b:
            own = counts[a:b]
            slot = np.arange(own.sum()) + np.repeat(block.starts[at[a:b]] - np.cumsum(own) + own, own)
            cell = np.repeat((doc[a:b] - begin) * n, own) + block.asking[slot]
            sums = np.bincount(cell, np.repeat(weights[a:b], own) * block.weights[slot], (end - begin) * n)
            matched = np.bincount(cell, block.times[slot], (end - begin) * n)
            if decimals is not None:
                sums = np.round(sums, decimals)
            some = np.flatnonzero((matched > 0) & (sums.reshape(-1, n) >= best.least).ravel())
            best.add(some % n, sums[some], matched[some], ids[begin + some // n])
        begin = end


def ranked_terms(terms: DataFrame, asked: DataFrame, k: int, decimals: int | None = None, counted: bool = False, column: str = "weights") -> DataFrame:
    """(query_id, doc_id, score, matched, rank): the ``k`` documents with the highest sums of their terms' weights times the question's, rounded
    to ``decimals``; then, with ``counted``, those with more terms, then by id.

    ``terms``: doc_id, terms, and the weights in ``column`` (null: not held); ``asked``: query_id, term, weight. Questions go to
    the tasks in blocks of at most ``BLOCK_TERMS``; only ``k`` rows a question leave a task."""
    from corpusmill.operators.lexical import top_k

    kind = asked.schema["query_id"].dataType.simpleString()
    once = asked.groupBy("query_id", "term").agg(F.sum("weight").alias("weight"), F.count("*").cast("double").alias("times"))
    rows = once.groupBy("query_id").agg(F.collect_list(F.struct("term", "weight", "times")).alias("r"))
    rows = stored(rows.select("query_id", F.col("r.term").alias("terms"), F.col("r.weight").alias("weights"), F.col("r.times").alias("times")), "asked-terms")
    every = terms.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("doc_id"), "terms", F.col(column).alias("weights"))
    parts = []
    for block in blocks(rows):

        def run(batches: Iterator[pa.RecordBatch], block: Block = block) -> Iterator[pa.RecordBatch]:
            best = Best(len(block.ids), k, counted)
            for batch in batches:
                score_batch(batch, block, best, decimals)
            best.judge()
            q, score, matched, ids = best.held
            for i in range(0, len(q), 100_000):
                own = [block.ids[x] for x in q[i : i + 100_000]]
                yield pa.RecordBatch.from_pydict({"query_id": own, "doc_id": ids[i : i + 100_000], "score": score[i : i + 100_000], "matched": matched[i : i + 100_000].astype(np.int64)})

        parts.append(every.mapInArrow(run, f"query_id {kind}, doc_id long, score double, matched long"))
    if not parts:
        return rows.limit(0).selectExpr("query_id", "0L doc_id", "0D score", "0L matched", "1 rank")
    found = parts[0]
    for part in parts[1:]:
        found = found.unionAll(part)
    order = [F.desc("score"), *([F.desc("matched")] if counted else []), "doc_id"]
    back = F.when(F.col("doc_id") != NO_ID, F.col("doc_id")).alias("doc_id")
    return top_k(found, k, ["query_id"], *order).select("query_id", back, "score", "matched", "rank")


def best_documents(posting: DataFrame, tokens: DataFrame, k: int, column: str = "weights") -> DataFrame:
    """``ranked_terms`` over a posting (token, doc_id, weight) or the stored terms of documents, for tokens (query_id, token)."""
    terms = posting if "terms" in posting.columns else by_document(posting)
    return ranked_terms(terms, tokens.select("query_id", F.xxhash64("token").alias("term"), F.lit(1.0).alias("weight")), k, column=column)
