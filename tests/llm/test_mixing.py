"""Mixing against a plain statement of it, with clashing columns, repeated ids and very long texts."""

import math
from collections import Counter, defaultdict

from pyspark.sql import functions as F

from corpusmill.llm import mixing
from corpusmill.llm.common import row_key
from corpusmill.llm.mixing import MixTarget, block_turn, mix_sources
from tests.llm.brute import blank_words, by_key


def plain_plan(tokens, target):
    """{source: (weight, tokens wanted)} with the exponent found by halving."""
    weights = lambda x: {s: n**x / sum(m**x for m in tokens.values()) for s, n in tokens.items()}
    repeats = lambda w: max(w[s] / tokens[s] for s in w) / min(w[s] / tokens[s] for s in w)
    entropy = lambda w: -sum(v * math.log(v) for v in w.values())
    low, high = 0.0, 1.0
    for _ in range(60):
        mid = (low + high) / 2
        w = weights(mid)
        up = entropy(w) >= target.entropy if target.entropy is not None else repeats(w) > target.repeats
        low, high = (mid, high) if up else (low, mid)
    w = weights(high)
    budget = target.budget or max(tokens[s] / w[s] for s in w)
    return {s: (w[s], w[s] * budget) for s in w}


def test_equals_the_plain_plan(spark, documents):
    rows = [(r.doc_id, r.source, len(blank_words(r.text))) for r in documents.collect()]
    tokens = Counter()
    for _, s, n in rows:
        tokens[s] += n
    for target in (MixTarget(repeats=1.7), MixTarget(repeats=None, entropy=2.9, budget=300_000)):
        plan = plain_plan(tokens, target)
        drawn = defaultdict(Counter)
        weight = {}
        for r in mix_sources(documents, target).collect():
            drawn[r.source][r.doc_id] += 1
            weight[r.source] = r.mix_weight
        for s in tokens:
            mine = {d: n for d, t, n in rows if t == s}
            assert abs(weight[s] - plan[s][0]) < 1e-6
            epochs = math.floor(plan[s][1] / tokens[s] + 1e-6)
            times = [drawn[s][d] for d in mine]
            assert set(times) <= {epochs, epochs + 1}
            used = sum(n * (drawn[s][d] - epochs) for d, n in mine.items())
            rest = plan[s][1] - epochs * tokens[s]
            left = [n for d, n in mine.items() if drawn[s][d] == epochs]
            assert used <= rest + 1 and (not left or used + max(left) > rest - 1)


def test_blocks_come_in_a_permutation(spark, documents, monkeypatch):
    for k in range(9):
        turns = spark.range(1 << k).select(block_turn(F.col("id"), F.lit(1 << k), F.lit("x"), F.lit(3))).collect()
        assert sorted(r[0] for r in turns) == list(range(1 << k))
    monkeypatch.setattr(mixing, "BLOCK_ROWS", 3)
    out = mix_sources(documents, MixTarget(repeats=1.0))
    blocks = out.groupBy("source").agg(F.count("*").alias("n")).withColumn("blocks", F.pow(F.lit(2.0), F.greatest(F.ceil(F.log2(F.col("n") / 3)), F.lit(0))).cast("long"))
    placed = out.join(blocks, "source").select("source", "mix_order", F.pmod(F.xxhash64(F.lit(11), row_key()), F.col("blocks")).alias("block")).collect()
    runs = defaultdict(list)
    for r in sorted(placed, key=lambda r: (r.source, r.mix_order)):
        if not runs[r.source] or runs[r.source][-1] != r.block:
            runs[r.source].append(r.block)
    assert all(len(b) == len(set(b)) for b in runs.values()) and any(len(b) > 2 and b != sorted(b) for b in runs.values())


def test_columns_of_any_name_are_kept(spark, edge_docs):
    names = ("key", "tokens", "weight", "rows", "blocks", "epochs", "rest", "before", "all", "row", "turn", "used", "mix_epoch", "mix_hash")
    docs = edge_docs.withColumns({n: F.concat(F.lit(n), F.coalesce("doc_id", F.lit(0))) for n in names})
    out = mix_sources(docs, MixTarget(repeats=1.0))
    assert out.columns == [*[c for c in docs.columns if c != "mix_epoch"], "mix_epoch", "mix_weight", "mix_order"]
    some = ["doc_id", "key", "tokens", "rest", "all"]
    assert by_key(map(tuple, out.where("mix_epoch = 0").select(some).collect())) == by_key(map(tuple, docs.select(some).collect()))
