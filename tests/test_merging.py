"""Merges into a stored table, what a crash leaves, and two merges at once."""

import random

import pytest

from corpusmill.sources.merging import Conflict, KeyedTable

SCHEMA = "k long, g string, n int, t string"


def rows(table, version=None):
    return sorted((tuple(r) for r in table.read(version).collect()), key=str)


@pytest.fixture
def table(spark, tmp_path):
    t = KeyedTable(spark, f"file://{tmp_path}/t", ["k", "g"], 8)
    t.replace_all(spark.createDataFrame([(i, "a", i, "old") for i in range(20)] + [(None, "a", 1, "null"), (3, None, 2, "null")], SCHEMA))
    return t


def test_merges_equal_a_dict(spark, table):
    rng = random.Random(4)
    held = {(r.k, r.g): tuple(r) for r in table.read().collect()}
    for step in range(5):
        new = [(rng.choice([None, *range(30)]), rng.choice(["a", "b", None]), rng.randrange(50), f"s{step}") for _ in range(15)]
        frame = spark.createDataFrame(new, SCHEMA)
        last = {}
        for r in sorted(new, key=lambda r: (r[2], r[3])):
            last[r[:2]] = r if r[:2] not in last or r[2] >= last[r[:2]][2] else last[r[:2]]
        matched, insert = [("ignore", True), ("replace", True), ({"n": "old.n + new.n", "t": "new.t"}, True), ("replace", False), ({"t": "concat(old.t, '+')"}, True)][step]
        condition = "new.n > old.n" if step in (1, 2) else None
        table.merge(frame, matched, insert, condition, ["n"])
        for key, r in last.items():
            if key not in held:
                held |= {key: r} if insert else {}
            elif condition is None or r[2] > held[key][2]:
                o = held[key]
                held[key] = o if matched == "ignore" else r if matched == "replace" else (*key, o[2] + r[2], r[3]) if "n" in matched else (*o[:3], o[3] + "+")
        assert rows(table) == sorted(held.values(), key=str), step


def test_only_touched_buckets_are_rewritten(spark, table):
    before = table.manifest(1)["buckets"]
    table.merge(spark.createDataFrame([(5, "a", 9, "new")], SCHEMA), "replace")
    after = table.manifest(2)["buckets"]
    assert sum(before[b] != after[b] for b in before) == 1 and (5, "a", 9, "new") in rows(table) and (5, "a", 5, "old") in rows(table, 1)


def test_a_crash_before_the_switch_changes_nothing(spark, table, monkeypatch):
    was = rows(table)
    monkeypatch.setattr(KeyedTable, "publish", lambda *a: (_ for _ in ()).throw(RuntimeError("lost")))
    with pytest.raises(RuntimeError):
        table.merge(spark.createDataFrame([(1, "a", 7, "new")], SCHEMA), "replace")
    monkeypatch.undo()
    assert rows(table) == was and table.versions() == [1]
    assert table.vacuum() == 1 and rows(table) == was


def test_the_second_of_two_merges_fails(spark, table, monkeypatch):
    monkeypatch.setattr(KeyedTable, "versions", lambda self: [1])
    table.merge(spark.createDataFrame([(1, "a", 7, "first")], SCHEMA), "replace")
    with pytest.raises(Conflict):
        table.merge(spark.createDataFrame([(1, "a", 8, "second")], SCHEMA), "replace")
    monkeypatch.undo()
    assert table.versions() == [1, 2] and (1, "a", 7, "first") in rows(table)


def test_an_empty_merge_and_a_snapshot(spark, table):
    was = rows(table)
    table.merge(spark.createDataFrame([], SCHEMA), "replace")
    assert rows(table) == was
    table.replace_all(spark.createDataFrame([], SCHEMA))
    assert rows(table) == [] and table.vacuum() >= 1
