import random

import numpy as np
import pytest

from corpusmill.llm.components import connected_components
from corpusmill.llm.neardup import fewest_matches, near_duplicates
from corpusmill.llm.simjoin import parity_sketch
from tests.llm.brute import components, near_components


@pytest.mark.parametrize(("shingle", "percent"), [(3, 85), (5, 80)])
def test_equals_all_pairs(spark, documents, shingle, percent):
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in near_duplicates(documents, shingle, percent).collect()}
    want = near_components([(r.doc_id, r.text) for r in documents.collect()], shingle, percent)
    assert got == {i: (n, c, i == c) for i, (n, c) in want.items()}


def test_a_large_group_of_edited_copies(spark):
    rng = random.Random(3)
    base = [f"w{i}" for i in range(150)]
    rows = []
    for i in range(150):
        words = list(base)
        for _ in range(rng.randint(0, 9)):
            words[rng.randrange(150)] = f"e{rng.randrange(400)}"
        rows.append((i, " ".join(words)))
    rows += [(1000 + i, " ".join(base)) for i in range(100)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(7)
    got = {r.doc_id: r.component_id for r in near_duplicates(docs, 3, 85).collect()}
    assert got == {i: c for i, (_, c) in near_components(rows, 3, 85).items()}


def test_edges(spark, edge_docs, no_docs):
    rows = near_duplicates(edge_docs, 3, 85).collect()
    assert len(rows) == edge_docs.count()
    by = {}
    for r in rows:
        by.setdefault(r.doc_id, []).append((r.n_shingles, r.component_id, r.kept))
    assert by[1] == [by[1][0]] * 2 and by[1][0][1:] == (1, True)
    assert by[3] == [(0, 3, True)] and by[4] == [(0, 4, True)] and by[5] == [(0, 5, True)]
    assert by[6] == [(1, 6, True)] and by[7] == [(1, 6, False)]
    assert all(c is None and kept for _, c, kept in by[None])
    assert near_duplicates(no_docs, 3, 85).count() == 0


def test_components_of_chains_and_stars(spark):
    pairs = [(i, i + 1) for i in range(0, 200)] + [(500, i) for i in range(501, 540)] + [(900, 900)]
    got = {r.id: r.component for r in connected_components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    want = components(pairs[:-1], {x for p in pairs for x in p} - {900})
    assert got == want
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_sketches_bound_the_difference():
    rng = np.random.default_rng(1)
    for n in (3, 40, 700):
        a = rng.integers(0, 1 << 63, n, np.uint64)
        b = np.concatenate([a[: n // 2], rng.integers(0, 1 << 63, n // 3, np.uint64)])
        bits = sum(bin((x ^ y) & (1 << 64) - 1).count("1") for x, y in zip(parity_sketch(a), parity_sketch(b), strict=True))
        assert bits <= len(set(a.tolist()) ^ set(b.tolist()))


def test_match_threshold():
    assert fewest_matches(48, 85) == 28
