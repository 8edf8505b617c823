import math
import random
import re
from collections import Counter

import duckdb
import numpy as np
import pytest

from corpusmill.llm import lexsearch
from corpusmill.llm.lexsearch import RANKED_SQL, Best, PostingList, ShardWriter, build_index, search, search_shard
from tests.llm.brute import LOWER
from tests.oracle import difference

WORD = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def plain(docs, items, k=50):
    """Every document scored for every item, from the contract."""
    words = [WORD.findall((t or "").translate(LOWER)) for _, t in docs]
    n = sum(bool(w) for w in words)
    total = sum(map(len, words))
    counts = [Counter(w) for w in words]
    df = Counter(t for c in counts for t in c)
    out = []
    for item, text in items:
        scores = []
        for (i, _), w, c in zip(docs, words, counts, strict=True):
            if w:
                m = 50 + (50 * len(w) * n) // total
                s = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 20 * m)) for t in set(WORD.findall((text or "").translate(LOWER))) if t in c)
                if s > 0:
                    scores.append((-s, i is None, i))
        out += [(item, r, i, -s) for r, (s, _, i) in enumerate(sorted(scores, key=lambda x: (x[0], x[1], x[2] or 0))[:k], 1)]
    return sorted(out, key=str)


def rows_of(df):
    return sorted(((r.item_id, r["rank"], r.doc_id, r.score) for r in df.collect()), key=str)


def test_equals_every_document_and_sql(spark, sf, documents):
    items = spark.read.parquet(f"{sf}/benchmark.parquet")
    got = search(build_index(documents), items).cache()
    assert rows_of(got) == plain([(r.doc_id, r.text) for r in documents.collect()], [(r.item_id, r.text) for r in items.collect()])
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf}/{t}.parquet')")
    assert difference(got, RANKED_SQL, con) == ""


@pytest.mark.parametrize("queries", [1000, 2])
def test_edges(spark, edge_docs, no_docs, monkeypatch, queries):
    monkeypatch.setattr(lexsearch, "QUERIES", queries)
    asked = [("a", "the quick QUICK fox w7"), ("a", "the quick QUICK fox w7"), ("b", None), ("c", "!!"), (None, "one"), ("d", "É é 日本 nothing"), ("e", "x" * 300_000)]
    items = spark.createDataFrame([(i, t, "clash") for i, t in asked], "item_id string, text string, term string")
    docs = edge_docs.repartition(4)
    assert rows_of(search(build_index(docs), items, 3)) == plain([(r.doc_id, r.text) for r in edge_docs.collect()], asked, 3)
    assert search(build_index(no_docs), items).count() == 0
    assert search(build_index(docs), items.limit(0)).count() == 0


def test_blocks_are_skipped_and_nothing_is_lost(monkeypatch):
    """One shard of many blocks: the search equals scoring all, and leaves most blocks packed."""
    rng = random.Random(5)
    shard, texts = ShardWriter(0), []
    for i in range(6000):
        words = [f"c{rng.randrange(6)}" for _ in range(rng.randrange(1, 30))]
        if i % 24 == 0 and i < 1500:
            words += [f"rare{rng.randrange(3)}"] * rng.randrange(1, 9)
        texts.append(words)
        shard.add(i, [w.encode() for w in words], 1)
    total = sum(map(len, texts))
    rows, ids, m = {}, None, None
    for batch in shard.blocks(len(texts), total):
        for _, term, _, n, impact, first, last, gaps, counts in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if term:
                rows.setdefault(term, []).append((n, impact, first, last, gaps, counts))
            else:
                ids, m = np.frombuffer(gaps, np.int64), np.frombuffer(counts, np.int64)
    lists = {t: PostingList(r) for t, r in rows.items()}
    df = {t: int(p.n.sum()) for t, p in lists.items()}
    weight = {t: math.floor(1000 * math.log((2 * len(texts) + 2) / (2 * n + 1))) for t, n in df.items()}
    asked = ["rare0", "rare1", "c0", "c1", "c5"]
    best = Best(10)
    monkeypatch.setattr(lexsearch, "STRETCH", 500)
    search_shard([(weight[t], lists[t]) for t in asked], ids, m, best)
    assert [(b, a) for a, b in zip(best.scores.tolist(), best.ids.tolist(), strict=True)] == [(i, s) for _, _, i, s in sorted(plain([(i, " ".join(w)) for i, w in enumerate(texts)], [("q", " ".join(asked))], 10), key=lambda r: r[1])]
    opened, every = (sum(f(lists[t]) for t in asked) for f in (lambda p: len(p.open), lambda p: len(p.n)))
    assert opened < every / 2
