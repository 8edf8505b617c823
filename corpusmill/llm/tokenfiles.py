"""Token ids in a binary file format: frequency-ranked ids, byte-aligned variable length.

Format: a Parquet folder whose rows are blocks of consecutive documents in
ascending ``doc_id`` order. A block has its documents' ids and token counts, the
control bytes of all its documents and, apart from them, their data bytes. Each
document begins a new control byte: four 2-bit lengths (bytes less one) a control
byte, then 1 to 4 little-endian bytes an id. What is coded is the rank of an id by
its frequency in the whole corpus, so the commonest 256 ids take one byte. The
ranks (one row a vocabulary entry) lie beside the blocks, and so do the numbers of
tokens before each range of documents. Decoding is a numpy table lookup on the
control bytes.

Words are looked up in bounded caches of words and pieces already encoded; only new pieces go
through the tokenizer, many at a time. Texts are worked on about 2 MB at once, a longer one alone. Text for which that could differ from the
whole-text encoding (special strings, characters whose case or composition depends
on their neighbours) goes through the tokenizer whole.

Defined cases: a null text counts as empty and has the end id alone; repeated
``doc_id`` rows keep a row each, next to each other; rows with a null ``doc_id``
come before all others; a very long text is one call and may be one block; other columns of the
input are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusmill.llm.common import discard, scratch_path, stored

BLOCK_TOKENS = 1 << 18
CACHE_WORDS = 200_000
CALL_BYTES, CALL_PIECES = 1 << 21, 4_000
LENGTHS = ((np.arange(256)[:, None] >> np.array([0, 2, 4, 6])) & 3).astype(np.int64) + 1


def encode_ranks(ranks: np.ndarray, counts: np.ndarray) -> tuple[list[bytes], list[bytes]]:
    """Control bytes and data bytes of each document; ``ranks`` has one after the other."""
    size = 1 + (ranks > 0xFF) + (ranks > 0xFFFF) + (ranks > 0xFFFFFF).astype(np.uint8)
    groups = -(-counts // 4)
    codes = np.zeros(groups.sum() * 4, np.uint8)
    codes[padded_places(counts)] = size - 1
    control = (codes.reshape(-1, 4) << np.array([0, 2, 4, 6], np.uint8)).sum(axis=1, dtype=np.uint8).tobytes()
    data = ranks.astype("<u4").view(np.uint8).reshape(-1, 4)[np.arange(4) < size[:, None]].tobytes()
    ends = np.append(0, np.cumsum(size, dtype=np.int64))[np.append(0, np.cumsum(counts))]
    stops = np.append(0, np.cumsum(groups))
    cut = lambda whole, at: [whole[i:j] for i, j in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
    return cut(control, stops), cut(data, ends)


def padded_places(counts: np.ndarray) -> np.ndarray:
    """Where each id's length stands when every document begins a new control byte."""
    groups = -(-counts // 4)
    shift = (np.cumsum(groups) - groups) * 4 - (np.cumsum(counts) - counts)
    return np.repeat(shift, counts) + np.arange(counts.sum())


def decode_ranks(control: np.ndarray, data: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The ranks of the documents of a block, one after the other."""
    size = LENGTHS[control].ravel()[padded_places(counts)]
    starts = np.cumsum(size) - size
    padded = np.concatenate([data, np.zeros(4, np.uint8)])
    raw = padded[starts[:, None] + np.arange(4)]
    raw[np.arange(4) >= size[:, None]] = 0
    return np.ascontiguousarray(raw).view("<u4").ravel()


def flat_ids(column: pa.BinaryArray) -> tuple[np.ndarray, np.ndarray]:
    """(all ids, number of each row) of a column of little-endian 32-bit integers."""
    offsets = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1]
    whole = np.frombuffer(column.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]]
    return np.frombuffer(whole.tobytes(), "<u4"), np.diff(offsets).astype(np.int64) // 4


def ragged(flat: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The runs of ``flat`` that begin at ``starts``, one after the other."""
    return flat[np.repeat(starts - (np.cumsum(sizes) - sizes), sizes) + np.arange(sizes.sum())]


class Seen:
    """Strings met before, with their ids. Past ``limit`` those met in one call only are forgotten."""

    def __init__(self, limit: int):
        self.limit = limit
        self.keep(None)

    def keep(self, at: np.ndarray | None) -> None:
        """Forget all but those at the given places; the empty string always stays, without ids."""
        if at is None or len(at) > self.limit // 2:
            self.names, self.sizes, self.flat = pa.array([""], pa.large_string()), np.zeros(1, np.int64), np.zeros(0, np.uint32)
        else:
            self.flat = ragged(self.flat, self.starts[at], self.sizes[at])
            self.names, self.sizes = self.names.take(pa.array(at)), self.sizes[at]
        self.starts = np.cumsum(self.sizes) - self.sizes
        self.calls = np.zeros(len(self.sizes), np.int32)

    def find(self, names: pa.Array) -> np.ndarray:
        """The place of each of the different ``names``, -1 for those not met before."""
        if len(self.names) + len(names) > self.limit:
            again = self.calls > 1
            again[0] = True
            self.keep(np.flatnonzero(again))
        at = pc.index_in(names, value_set=self.names).fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64)
        self.calls[at[at >= 0]] += 1
        return at

    def add(self, names: pa.Array, flat: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """Take up new names; their places."""
        first = len(self.sizes)
        self.names = pa.concat_arrays([self.names, names])
        self.starts = np.concatenate([self.starts, len(self.flat) + np.cumsum(sizes) - sizes])
        self.sizes = np.concatenate([self.sizes, sizes])
        self.flat = np.concatenate([self.flat, flat])
        self.calls = np.concatenate([self.calls, np.ones(len(sizes), np.int32)])
        return np.arange(first, len(self.sizes))


class WordCodec:
    """Whole texts to ids, equal to ``Tokenizer.encode(text, add_special_tokens=False)``.

    Arrow tells the different words of a call apart. Words not met before are cut into the
    tokenizer's pieces (letters, one digit, signs), and pieces not met before are encoded."""

    #: Fixed value: the tokenizer's own pattern for pieces of a word.
    PIECES = r"('s|'t|'re|'ve|'m|'ll|'d|\pL+|\pN|[^\s\pL\pN]+)"
    #: Texts with these go through the tokenizer whole.
    ODD = r"[^\x00-\x1b\x20-\x{12f}\x{131}-\x{24f}\x{2010}-\x{2027}\x{2030}-\x{203a}]|<\|"

    def __init__(self, path: str):
        from tokenizers import Tokenizer, pre_tokenizers

        self.path, self.whole = path, None
        self.parts = Tokenizer.from_file(path)
        self.parts.normalizer = None
        self.parts.pre_tokenizer = pre_tokenizers.Sequence(
            [pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)]
        )
        #: Whether a token ends a piece.
        self.ends = np.zeros(self.parts.get_vocab_size(), bool)
        self.ends[[i for token, i in self.parts.get_vocab().items() if token.endswith("</w>")]] = True
        self.words, self.pieces = Seen(CACHE_WORDS), Seen(CACHE_WORDS)

    def piece_ids(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all pieces, number of each)."""
        flat, sizes = [], []
        for some in (pieces[at : at + CALL_PIECES] for at in range(0, len(pieces), CALL_PIECES)):
            ids = np.array(self.parts.encode_batch_fast([" ".join(some)], add_special_tokens=False)[0].ids, np.uint32)
            stops = np.flatnonzero(self.ends[ids]) + 1
            if len(stops) == len(some) and stops[-1] == len(ids):
                flat.append(ids)
                sizes.append(np.diff(np.append(0, stops)))
            else:
                each = [np.array(e.ids, np.uint32) for e in self.parts.encode_batch_fast(some, add_special_tokens=False)]
                flat += each
                sizes.append(np.array([len(e) for e in each], np.int64))
        return np.concatenate(flat), np.concatenate(sizes)

    def word_ids(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all words, number of each)."""
        mixed = pc.invert(pc.utf8_is_alpha(words))
        cut = pc.replace_with_mask(words, mixed, pc.replace_substring_regex(words.filter(mixed), self.PIECES, r"\1 "))
        lists = pc.ascii_split_whitespace(cut)
        coded = lists.flatten().dictionary_encode()
        at = self.pieces.find(coded.dictionary)
        new = coded.dictionary.filter(pa.array(at < 0))
        if len(new):
            at[at < 0] = self.pieces.add(new, *self.piece_ids(new.to_pylist()))
        at = at[coded.indices.to_numpy()]
        ends = np.append(0, np.cumsum(self.pieces.sizes[at]))[lists.offsets.to_numpy()]
        return ragged(self.pieces.flat, self.pieces.starts[at], self.pieces.sizes[at]), np.diff(ends)

    def whole_text(self, text: str) -> list[int]:
        from tokenizers import Tokenizer

        self.whole = self.whole or Tokenizer.from_file(self.path)
        return self.whole.encode(text, add_special_tokens=False).ids

    def encode(self, texts: pa.Array | list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts one after the other, number of each)."""
        texts = pa.array(texts, pa.large_string()) if isinstance(texts, list) else texts.cast(pa.large_string()).fill_null("")
        odd = pc.match_substring_regex(texts, self.ODD)
        split = pc.utf8_split_whitespace(pc.utf8_lower(pc.if_else(odd, "", texts)))
        coded = split.flatten().dictionary_encode()
        at = self.words.find(coded.dictionary)
        new = coded.dictionary.filter(pa.array(at < 0))
        if len(new):
            at[at < 0] = self.words.add(new, *self.word_ids(new))
        at = at[coded.indices.to_numpy()]
        size = self.words.sizes[at]
        ids = ragged(self.words.flat, self.words.starts[at], size)
        ends = np.append(0, np.cumsum(size))[split.offsets.to_numpy()]
        if not pc.any(odd).as_py():
            return ids, np.diff(ends)
        whole = odd.to_numpy(zero_copy_only=False)
        parts = [
            np.array(self.whole_text(texts[i].as_py()), np.uint32) if whole[i] else ids[ends[i] : ends[i + 1]] for i in range(len(texts))
        ]
        return np.concatenate(parts), np.array([len(x) for x in parts])


@lru_cache(maxsize=1)
def codec(path: str) -> WordCodec:
    """One codec for each Python worker, kept between its tasks."""
    return WordCodec(path)


def slices(batch: pa.RecordBatch, column: int, limit: int = CALL_BYTES) -> Iterator[pa.RecordBatch]:
    """``batch`` in runs of rows whose values in ``column`` have about ``limit`` bytes together, or one row each."""
    size = pc.binary_length(batch.column(column)).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
    run = np.cumsum(size) // limit
    edges = np.append(np.flatnonzero(np.diff(run, prepend=-1)), len(size))
    for low, high in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
        yield batch.slice(low, high - low)


def tokenized(docs: DataFrame, tokenizer: str, end_id: int) -> DataFrame:
    """(doc_id, ids): the ids of each text and the end id, as little-endian 32-bit integers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(tokenizer)
        for batch in batches:
            for part in slices(batch, 1):
                ids, counts = own.encode(part.column(1))
                ends = np.cumsum(counts)
                ids = np.insert(ids, ends, end_id)
                offsets = np.append(0, 4 * (ends + np.arange(1, len(ends) + 1))).astype(np.int32)
                coded = pa.Array.from_buffers(pa.binary(), len(counts), [None, pa.py_buffer(offsets), pa.py_buffer(ids.astype("<u4"))])
                yield pa.RecordBatch.from_arrays([part.column(0), coded], names=["doc_id", "ids"])

    return docs.selectExpr("cast(doc_id as long) doc_id", "text").mapInArrow(run, "doc_id long, ids binary")


def id_counts(tokens: DataFrame) -> DataFrame:
    """(id, n) over the whole corpus; a task gives a row for each id that it saw."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(0, np.int64)
        for batch in batches:
            seen = np.bincount(flat_ids(batch.column(0))[0], minlength=len(total))
            seen[: len(total)] += total
            total = seen
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], names=["id", "n"])

    return tokens.select("ids").mapInArrow(run, "id long, n long").groupBy("id").agg(F.sum("n").alias("n"))


BLOCK = "part int, seq int, part_start long, doc_ids array<long>, n_tokens array<long>, control binary, data binary"
BLOCK_FIELDS = pa.schema(
    {
        "part": pa.int32(), "seq": pa.int32(), "part_start": pa.int64(), "doc_ids": pa.list_(pa.int64()),
        "n_tokens": pa.list_(pa.int64()), "control": pa.binary(), "data": pa.binary(),
    }
)


def write_token_files(docs: DataFrame, folder: str, tokenizer: str, end_id: int = 1) -> None:
    """Encode ``docs`` (doc_id, text) into ``folder``: blocks, ranks and offsets.

    Two passes over the ids: one counts them for the ranks, one codes them. Only
    the ranks (at most one row a vocabulary entry) and the bounds of the doc_id
    ranges (a few for each shuffle partition) reach the driver.
    """
    spark = docs.sparkSession
    n_parts = 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    cut = docs.agg(F.percentile_approx(F.col("doc_id").cast("long"), [i / n_parts for i in range(1, n_parts)], 100 * n_parts)).first()[0]
    bounds = np.unique(np.array(cut or [], np.int64))
    tokens = stored(tokenized(docs, tokenizer, end_id), "tokens")
    ranks = id_counts(tokens).orderBy(F.desc("n"), "id")
    ordered = [r.id for r in ranks.collect()]
    spark.createDataFrame([(r, i) for r, i in enumerate(ordered)], "rank long, id long").coalesce(1).write.parquet(f"{folder}/ranks")
    rank_of = np.zeros(max(ordered, default=0) + 1, np.uint32)
    rank_of[ordered] = np.arange(len(ordered), dtype=np.uint32)

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            doc_ids = batch.column(0)
            plain = doc_ids.fill_null(-(2**63)).to_numpy(zero_copy_only=False)
            for at in range(0, batch.num_rows, 1024):
                ids, counts = flat_ids(batch.column(1).slice(at, 1024))
                control, data = encode_ranks(rank_of[ids], counts)
                part = np.searchsorted(bounds, plain[at : at + 1024], "right").astype(np.int32)
                arrays = [pa.array(part), doc_ids.slice(at, 1024), pa.array(counts), pa.array(control, pa.binary()), pa.array(data, pa.binary())]
                yield pa.RecordBatch.from_arrays(arrays, names=["part", "doc_id", "n", "control", "data"])

    def assemble(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, seq, start, fill, held = None, 0, 0, 0, []

        def block() -> pa.RecordBatch:
            doc_ids, counts, control, data = zip(*held, strict=True)
            values = [part], [seq], [start], [doc_ids], [counts], [b"".join(control)], [b"".join(data)]
            return pa.RecordBatch.from_arrays(
                [pa.array(v, f.type) for v, f in zip(values, BLOCK_FIELDS, strict=True)], schema=BLOCK_FIELDS
            )

        for batch in batches:
            for own, doc, n, control, data in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if held and (own != part or fill + n > BLOCK_TOKENS):
                    yield block()
                    start, seq, fill, held = start + fill, seq + 1, 0, []
                if own != part:
                    part, seq, start = own, 0, 0
                held.append((doc, n, control, data))
                fill += n
        if held:
            yield block()

    blocks = (
        tokens.mapInArrow(code, "part int, doc_id long, n long, control binary, data binary")
        .repartitionById(n_parts // 4, F.expr("part div 4").cast("int"))
        .sortWithinPartitions("part", "doc_id", "n", "data")
        .mapInArrow(assemble, BLOCK)
    )
    blocks.write.parquet(f"{folder}/blocks")
    discard(tokens)
    written = spark.read.schema(BLOCK).parquet(f"{folder}/blocks")
    totals = written.groupBy("part").agg(F.sum(F.aggregate("n_tokens", F.lit(0).cast("long"), lambda a, x: a + x)).alias("n"))
    rows, before = sorted((r.part, r.n) for r in totals.collect()), 0
    offsets = []
    for part, n in rows:
        offsets.append((part, before))
        before += n
    spark.createDataFrame(offsets, "part int, before long").coalesce(1).write.parquet(f"{folder}/offsets")


def read_token_files(spark, folder: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids) of each document in ``folder``; ids are
    little-endian 32-bit integers."""
    ordered = [r.id for r in spark.read.parquet(f"{folder}/ranks").orderBy("rank").collect()]
    id_of = np.array(ordered, "<u4")

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start, doc_ids, counts, control, data in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                n = np.array(counts, np.int64)
                ranks = decode_ranks(np.frombuffer(control, np.uint8), np.frombuffer(data, np.uint8), n)
                whole = id_of[ranks].tobytes()
                ends = 4 * np.cumsum(n)
                ids = [whole[i:j] for i, j in zip((ends - 4 * n).tolist(), ends.tolist(), strict=True)]
                starts = start + np.cumsum(n) - n
                yield pa.RecordBatch.from_arrays(
                    [pa.array(doc_ids, pa.int64()), pa.array(starts), pa.array(n), pa.array(ids, pa.binary())],
                    names=["doc_id", "start", "n_tokens", "ids"],
                )

    blocks = spark.read.schema(BLOCK).parquet(f"{folder}/blocks")
    offsets = spark.read.schema("part int, before long").parquet(f"{folder}/offsets")
    return (
        blocks.join(offsets, "part")
        .select((F.col("before") + F.col("part_start")).alias("start"), "doc_ids", "n_tokens", "control", "data")
        .mapInArrow(decode, "doc_id long, start long, n_tokens long, ids binary")
    )


def token_digests(docs: DataFrame, tokenizer: str, end_id: int = 1) -> DataFrame:
    """Write ``docs`` as token files in the shared folder, read them back, and give
    each document's place, count and checksum."""
    folder = scratch_path(docs.sparkSession, "token-files")
    write_token_files(docs, folder, tokenizer, end_id)
    return read_token_files(docs.sparkSession, folder).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))
