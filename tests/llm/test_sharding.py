"""k-d splits against a plain statement of them; repeated rows; shards of a target size."""

import random
from collections import Counter, defaultdict

from pyspark.sql import functions as F

from corpusmill.llm.sharding import HASH_BITS, PLACE_BITS, kd_splits, place_rows, shard_documents, with_shards
from tests.llm.brute import by_key


def plain_splits(rows, n_leaves):
    """Shard of each (a, b, weight, tie)."""
    width = [max(r[d] for r in rows) - min(r[d] for r in rows) for d in (0, 1)]
    top, out = (1 << PLACE_BITS) - 1, {}

    def split(members, shard, leaves):
        if leaves == 1 or not members:
            for i in members:
                out[i] = shard
            return
        low = [min(rows[i][d] for i in members) for d in (0, 1)]
        spread = [max(rows[i][d] for i in members) - low[d] for d in (0, 1)]
        dim = max((0, 1), key=lambda d: spread[d] / width[d] if width[d] else 0.0)
        key = lambda i: int((rows[i][dim] - low[dim]) / spread[dim] * top if spread[dim] else 0) * (1 << HASH_BITS) + rows[i][3]
        members = sorted(members, key=key)
        goal, below, cut = sum(rows[i][2] for i in members) * (leaves // 2) / leaves, 0, len(members)
        for k, i in enumerate(members):
            if below + rows[i][2] >= goal - 1e-6:
                cut = k + (below + rows[i][2] - goal < goal - below)
                break
            below += rows[i][2]
        split(members[:cut], shard, leaves // 2)
        split(members[cut:], shard + leaves // 2, leaves - leaves // 2)

    split(range(len(rows)), 0, n_leaves)
    return out


def test_splits_equal_plain_ones(spark):
    rng = random.Random(2)
    rows = [(rng.gauss(0, 3), float(rng.randrange(4)), rng.randrange(1, 40), rng.randrange(1 << HASH_BITS)) for _ in range(700)]
    frame = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, a double, b double, weight int, tie long").cache()
    for leaves in (2, 5, 8):
        levels = kd_splits(frame.drop("i"), ["a", "b"], "weight", leaves)
        got = {r.i: r.shard for r in with_shards(frame, ["a", "b"], levels).collect()}
        assert got == plain_splits(rows, leaves)


def test_equal_rows_are_dealt_out(spark):
    for value in (1, None):
        copies = spark.range(400).select(F.lit(value).cast("long").alias("doc_id"), F.lit("same text").alias("text"), F.lit("en").alias("lang"), F.lit("s").alias("source"))
        rows = shard_documents(copies, 8).collect()
        sizes = Counter(r.shard for r in rows)
        assert len(sizes) == 8 and max(sizes.values()) - min(sizes.values()) <= 2
        slots = defaultdict(list)
        for r in rows:
            slots[r.shard].append(r.slot)
        assert all(sorted(s) == list(range(len(s))) for s in slots.values())


def test_leaves_of_a_target_size(spark, documents):
    rows = place_rows(documents, target_bytes=20_000).select("shard", (F.octet_length("text") + 8).alias("size")).collect()
    bytes_of = Counter()
    for r in rows:
        bytes_of[r.shard] += r["size"]
    longest = max(r["size"] for r in rows)
    assert len(bytes_of) >= sum(bytes_of.values()) / 20_000 - 1 and max(bytes_of.values()) <= 20_000 + 2 * longest


def test_columns_of_any_name_are_kept(spark, edge_docs):
    docs = edge_docs.withColumns({n: F.concat(F.lit(n), F.coalesce("doc_id", F.lit(0))) for n in ("row", "tie", "one", "range", "split", "node", "before", "dim_size", "text_crc32")})
    out = place_rows(docs, 3)
    assert out.columns == [*[c for c in docs.columns if c not in ("shard", "slot")], "shard", "slot"]
    some = ["doc_id", "row", "tie", "size", "text_crc32", "n"]
    assert by_key(map(tuple, out.select(some).collect())) == by_key(map(tuple, docs.select(some).collect()))


def test_a_level_looks_up_its_own_splits_alone(spark, monkeypatch):
    """What is broadcast for a level doesn't grow with the levels before it."""
    from corpusmill.llm import sharding

    tables, build = [], sharding.small_table
    monkeypatch.setattr(sharding, "small_table", lambda *a: tables.append(a) or build(*a))
    frame = spark.range(4_000).selectExpr("cast(id as double) a", "cast(id % 7 as double) b", "1 weight", f"pmod(xxhash64(id), {1 << HASH_BITS}) tie")
    levels = kd_splits(frame, ["a", "b"], "weight", 16)
    assert len(levels) == 4 and len(tables) == 3 * 3 + 2
