import duckdb
import numpy as np
import pytest

from corpusmill.llm import vectordup
from corpusmill.llm.vectordup import Codes, vector_duplicates
from tests.llm.brute import components
from tests.oracle import difference

SCHEMA = "vec_id long, embedding array<float>, label int, node string, key string, unit string"


def frame(spark, rows):
    return spark.createDataFrame([(i, e, 1, "x", "y", "z") for i, e in rows], SCHEMA).repartition(5)


def unit(x):
    return x / np.linalg.norm(x, axis=-1, keepdims=True)


def plain(rows, threshold):
    """(vec_id, n_links, component_id, kept) of every row over all pairs, and the number of links."""
    m = unit(np.array([e for _, e in rows], np.float32).astype(float))
    same = m @ m.T >= threshold
    np.fill_diagonal(same, False)
    place = components([(a, b) for a, b in np.argwhere(same).tolist()], range(len(rows)))
    least = {}
    for k, (i, _) in enumerate(rows):
        least[place[k]] = min(least.get(place[k], i), i)
    return sorted((i, int(same[k].sum()), least[place[k]], i == least[place[k]]) for k, (i, _) in enumerate(rows)), int(same.sum())


def rows_of(df):
    return sorted(((r.vec_id, r.n_links, r.component_id, r.kept) for r in df.collect()), key=str)


def around(rng, centre, angle, n):
    """Unit vectors at about the given angle to a centre."""
    side = unit(rng.standard_normal((n, len(centre))))
    side = unit(side - np.outer(side @ centre, centre))
    return np.cos(angle)[:, None] * centre + np.sin(angle)[:, None] * side


def groups(rng, dim=64):
    """Tight groups, two balls at the threshold's distance, a loose group, copies, and others."""
    centres = unit(rng.standard_normal((4, dim)))
    second = around(rng, centres[0], np.array([0.25]), 1)[0]
    parts = [
        around(rng, centres[0], rng.uniform(0.02, 0.11, 200), 200), around(rng, second, rng.uniform(0.02, 0.12, 150), 150),
        around(rng, centres[1], rng.uniform(0.17, 0.22, 120), 120), np.repeat(centres[2:3], 30, axis=0) * rng.choice([1.0, 2.0, 4.0], (30, 1)),
        around(rng, centres[3], rng.uniform(0.0, 0.35, 40), 40), rng.standard_normal((300, dim)),
    ]
    m = np.concatenate(parts).astype(np.float32)
    return [(int(i), e.tolist()) for i, e in zip(rng.permutation(len(m)) + 10, m, strict=True)]


@pytest.mark.parametrize("light", [256, 24])
def test_equals_all_pairs(spark, monkeypatch, light):
    monkeypatch.setattr(vectordup, "LIGHT", light)
    monkeypatch.setattr(vectordup, "BLOCK", 16 if light == 24 else 1024)
    rows = groups(np.random.default_rng(2))
    want, links = plain(rows, 0.95)
    got = rows_of(vector_duplicates(frame(spark, rows), 0.95, 0.9999))
    assert [r[0] for r in got] == sorted([r[0] for r in want], key=str)
    by = {r[0]: r for r in want}
    assert all(n <= by[i][1] for i, n, _, _ in got)
    assert sum(r[1] for r in got) >= 0.999 * links
    assert sum(r[2:] == by[r[0]][2:] for r in got) >= 0.995 * len(got)


def test_recall_with_production_parameters(spark):
    """Pairs just above the threshold, each vector in one, against brute force."""
    rng = np.random.default_rng(6)
    m = unit(rng.standard_normal((1500, 64)))
    near = np.concatenate([around(rng, c, np.array([0.315]), 1) for c in m])
    rows = [(i, e.tolist()) for i, e in enumerate(np.concatenate([m, near]).astype(np.float32))]
    want, links = plain(rows, 0.95)
    got = rows_of(vector_duplicates(frame(spark, rows)))
    assert links >= 2900 and sum(r[1] for r in got) >= 0.96 * links
    assert {i: n for i, n, _, _ in got if n} == {i: n for i, n, _, _ in got if n and n <= dict((r[0], r[1]) for r in want)[i]}


def test_edges(spark):
    nan, inf = float("nan"), float("inf")
    odd = [(1, None), (2, []), (3, [0.0, 0.0]), (4, [nan, 1.0]), (5, [1.0, None]), (6, [inf, 0.0]), (None, None)]
    good = [(10, [1.0, 0.0]), (10, [1.0, 0.0]), (11, [2.0, 0.1]), (12, [0.0, 1e-30]), (13, [-1.0, 0.0]), (14, [1.0]), (15, [3.0]), (None, [5.0, 0.0]), (16, [3e38, 3e38])]
    got = rows_of(vector_duplicates(frame(spark, odd + good)))
    want = [(i, 0, i, True) for i, _ in odd] + [(10, 3, 10, True), (10, 3, 10, True), (11, 3, 10, False), (12, 0, 12, True), (13, 0, 13, True), (14, 1, 14, True), (15, 1, 14, False), (None, 3, None, True), (16, 0, 16, True)]
    assert got == sorted(want, key=str)
    assert vector_duplicates(frame(spark, odd)).count() == len(odd)
    assert vector_duplicates(spark.createDataFrame([], SCHEMA)).count() == 0


def test_real_table_equals_all_pairs_and_sql(spark, sf, tmp_path):
    table = spark.read.parquet(f"{sf}/embeddings.parquet")
    copies = table.limit(40).selectExpr("vec_id + 900 vec_id", "transform(embedding, x -> cast(x * 2 + 0.001 as float)) embedding", "label")
    more = table.unionByName(copies).cache()
    more.toPandas().to_parquet(tmp_path / "embeddings.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM read_parquet('{tmp_path}/embeddings.parquet')")
    assert difference(vector_duplicates(more), vectordup.LINKS_SQL, con) == ""
    assert rows_of(vector_duplicates(table)) == sorted(plain([(r.vec_id, r.embedding) for r in table.collect()], 0.95)[0], key=str)


def test_estimates_are_unbiased_and_bounded():
    rng = np.random.default_rng(9)
    a = unit(rng.standard_normal((400, 64)))
    b = np.concatenate([around(rng, x, np.array([0.3]), 1) for x in a])
    found = []
    for seed in range(20):
        plan = Codes(0.95, 12, 20, seed)
        p, _, ea = plan.decode(*plan.encode(a), 64)
        _, q, eb = plan.decode(*plan.encode(b), 64)
        estimate, cosine = (p * q).sum(axis=1), (a * b).sum(axis=1)
        spread = np.sqrt(((ea + eb) * (1 - cosine**2) + ea * eb) / 63)
        found.append((estimate - cosine) / spread)
    z = np.concatenate(found)
    assert abs(z.mean()) < 0.05 and 0.5 < z.std() < 1.1 and np.abs(z).max() < 5
