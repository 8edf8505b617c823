"""Exact cosine retrieval in double precision."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusmill.session import stored

#: Bytes of question vectors that go to the tasks at once, and products that one step of a task holds.
BLOCK_BYTES, PRODUCTS = 8_000_000, 2_000_000


def dot(a: Column, b: Column) -> Column:
    products = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def normalised(vectors: DataFrame, column: str = "embedding") -> DataFrame:
    """With ``unit``: the vector over its norm; null for a zero vector."""
    unit = lambda n: F.when(n > 0, F.transform(column, lambda x: x.cast("double") / n))
    return vectors.withColumn("unit", F.transform(F.array(norm(F.col(column))), unit)[0])  # bound, else a filter on it takes the norm for each component


def question_blocks(queries: DataFrame) -> Iterator[tuple[list, np.ndarray]]:
    """(ids, matrix) of (query_id, unit), of at most ``BLOCK_BYTES``, one length of vector each."""
    held: dict[int, list] = {}
    for row in queries.select("query_id", "unit").toLocalIterator(prefetchPartitions=True):
        if row.unit is not None:
            own = held.setdefault(len(row.unit), [])
            own.append(row)
            if len(own) * len(row.unit) * 8 >= BLOCK_BYTES:
                yield [r.query_id for r in own], np.array([r.unit for r in own], float)
                del held[len(row.unit)]
    for own in held.values():
        yield [r.query_id for r in own], np.array([r.unit for r in own], float)


class Nearest:
    """The best ``k`` (score, id) of each question so far; ties by the smaller id."""

    def __init__(self, questions: np.ndarray, k: int, floor: float):
        self.questions, self.k = questions, k
        self.least = np.full(len(questions), np.nextafter(floor, np.inf))
        self.scores: list[np.ndarray] = [np.zeros(0)] * len(questions)
        self.ids: list[np.ndarray] = [np.zeros(0, np.int64)] * len(questions)

    def add(self, ids: np.ndarray, units: np.ndarray) -> None:
        products = np.round(units @ self.questions.T, 6)
        row, asked = np.nonzero(products >= self.least)
        order = np.argsort(asked, kind="stable")
        row, asked = row[order], asked[order]
        heads = np.flatnonzero(np.r_[True, asked[1:] != asked[:-1]]) if len(asked) else []
        for a, b in zip(heads, np.append(heads[1:], len(asked)) if len(asked) else [], strict=True):
            q = asked[a]
            scores, own = np.append(self.scores[q], products[row[a:b], q]), np.append(self.ids[q], ids[row[a:b]])
            best = np.lexsort((own, -scores))[: self.k]
            self.scores[q], self.ids[q] = scores[best], own[best]
            if len(best) == self.k:
                self.least[q] = self.scores[q][-1]


def cosine_topk(queries: DataFrame, vectors: DataFrame, k: int, floor: float = 0.0) -> DataFrame:
    """(query_id, vec_id, score, rank) above ``floor``, ties by id, for (query_id, unit) over (vec_id, unit).

    Questions go to the tasks in blocks of at most ``BLOCK_BYTES``. A task multiplies its vectors with a whole block
    and keeps ``k`` rows a question, which alone are shuffled. Vectors of other lengths, null ones and those without an id don't count."""
    from corpusmill.operators.lexical import top_k

    parts = []
    asked = stored(queries.select("query_id", "unit"), "questions")
    every = vectors.where("unit IS NOT NULL AND vec_id IS NOT NULL").select(F.col("vec_id").cast("long").alias("vec_id"), "unit")
    kind = asked.schema["query_id"].dataType.simpleString()
    for ids, questions in question_blocks(asked):

        def run(batches: Iterator[pa.RecordBatch], ids: list = ids, questions: np.ndarray = questions) -> Iterator[pa.RecordBatch]:
            best, width = Nearest(questions, k, floor), questions.shape[1]
            step = max(1, PRODUCTS // len(questions))
            for batch in batches:
                batch = batch.filter(pc.equal(pc.list_value_length(batch.column(1)), width))
                matrix = batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(-1, width)
                own = batch.column(0).to_numpy()
                for at in range(0, len(own), step):
                    best.add(own[at : at + step], matrix[at : at + step])
            for q, scores, found in zip(ids, best.scores, best.ids, strict=True):
                if len(found):
                    yield pa.RecordBatch.from_pydict({"query_id": [q] * len(found), "vec_id": found, "score": scores})

        parts.append(every.mapInArrow(run, f"query_id {kind}, vec_id long, score double"))
    if not parts:
        return asked.limit(0).selectExpr("query_id", "0L vec_id", "0D score", "1 rank")
    found = parts[0]
    for part in parts[1:]:
        found = found.unionAll(part)
    return top_k(found, k, ["query_id"], F.desc("score"), "vec_id")
