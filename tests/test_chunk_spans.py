"""Chunks carry their places: the source between them is the content, and coverage is the union of places."""

import re

import pytest
from pyspark.sql import functions as F

from corpusmill.operators import chunking as C
from corpusmill.plans.structures import notes

SMALL = "/root/testdata/sf0.001"
MIXED = {
    "a.md": "---\ntitle: x\n---\n# Head\n\nfirst words. second words! " + "long sentence here. " * 60 + "\n\n## Sub\n- one\n- two\n" + "\n".join(f"- item {i} " + "w" * 60 for i in range(30)) + "\n\nend",
    "b.md": "```py\n" + "\n".join(f"call({i})" for i in range(200)) + "\n```\n\n| a | b |\n|---|---|\n" + "\n".join(f"| {i} | {'v' * 30} |" for i in range(40)),
    "c.md": "> note\n\n   indented text   \n\n" + "x" * 2000, "d.md": "", "e.md": "---\nonly: meta\n---\n", "f.md": "日本語。" * 300 + "\n\n😀 tail",
}


def squeezed(text):
    return re.sub(r"\s+", "", text)


@pytest.fixture(scope="module")
def mixed(spark):
    return spark.createDataFrame(list(MIXED.items()), "path string, text string")


def test_places_slice_the_source(spark, mixed):
    every = notes(spark, SMALL).unionByName(mixed)
    source = {r.path: r.text for r in every.collect()}
    rows = C.structure_chunks(every).collect()
    assert {r.path for r in rows} >= {p for p, t in source.items() if t.strip() and p not in ("d.md", "e.md")}
    for r in rows:
        own, here = squeezed(r.content), squeezed(source[r.path][r.start : r.end])
        if r.kind in ("table", "fence"):
            assert here in own or own in here
        else:
            assert own == here, r.path


def test_merged_places_hold_their_parts(spark, mixed):
    every = notes(spark, SMALL).limit(40).unionByName(mixed)
    source = {r.path: r.text for r in every.collect()}
    for r in C.merged_chunks(C.structure_chunks(every)).collect():
        if r.kind not in ("table", "fence"):
            assert squeezed(r.content) == squeezed(source[r.path][r.start : r.end])


def plain_merge(parts, least):
    """Two passes over (kind, content): headings go before what follows, short prose joins the prose before."""
    first, i = [], 0
    while i < len(parts):
        kind, content = parts[i]
        if kind == "heading" and i + 1 < len(parts) and parts[i + 1][0] != "heading" and len(content) + len(parts[i + 1][1]) + 1 <= C.HARD:
            first.append((parts[i + 1][0], "heading_prefix", content + "\n" + parts[i + 1][1]))
            i += 2
        else:
            first.append((kind, "heading_only" if kind == "heading" else kind, content))
            i += 1
    out = []
    for kind, reason, content in first:
        if out and out[-1][1] in C.PROSE and reason in C.PROSE and min(len(out[-1][2]), len(content)) < least and len(out[-1][2]) + len(content) + 1 <= C.HARD:
            out[-1] = (kind, "short_merge", out[-1][2] + "\n" + content)
        else:
            out.append((kind, reason, content))
    return out


def test_short_prose_joins_in_chains(spark):
    import random

    rng = random.Random(8)
    cases = []
    for i in range(60):
        parts = [(rng.choice(["paragraph", "paragraph", "heading", "list"]), rng.choice("abc") * rng.choice([5, 20, 70, 300, 790])) for _ in range(rng.randrange(1, 12))]
        cases.append((i, parts))
    rows = spark.createDataFrame([(i, [(k, k, c, 0, 0) for k, c in parts]) for i, parts in cases], "i int, parts " + C.MERGE)
    got = {r.i: [(m.kind, "heading_only" if m.reason == "heading" else m.reason, m.content) for m in r.m] for r in rows.select("i", C.merged_runs(F.col("parts"), 64).alias("m")).collect()}
    assert got == {i: plain_merge(parts, 64) for i, parts in cases}
    note = spark.createDataFrame([("n.md", "# A\n\none\n\n# B\n\n- x\n\nafter\n\nmore")], "path string, text string")
    assert [(r.reason, r.content) for r in C.merged_chunks(C.structure_chunks(note)).orderBy("block", "piece").collect()] == [("heading_prefix", "# A\none"), ("short_merge", "# B\n- x\nafter\nmore")]


def test_coverage_is_the_union_of_places(spark):
    text = "0123456789 abcdefghij KLMNOPQRST"
    note = spark.createDataFrame([("n", text), ("none", "words"), ("empty", " ")], "path string, text string")
    places = [("n", 0, 5), ("n", 3, 8), ("n", 8, 12), ("n", 20, 24), ("n", 21, 22)]
    got = {r.path: (r.source_chars, r.covered_chars, r.coverage) for r in C.coverage(note, spark.createDataFrame(places, "path string, start int, end int")).collect()}
    held = {i for _, s, e in places for i in range(s, e) if not text[i].isspace()}
    assert got == {"n": (30, len(held), round(len(held) / 30, 3)), "none": (5, 0, 0.0), "empty": (0, 0, 0.0)}


def test_every_note_is_covered_and_judged(spark, mixed):
    rows = {r.path: r for r in C.validation(mixed, C.structure_chunks(mixed)).collect()}
    assert len(rows) == len(MIXED) and rows["d.md"].problems == "no_chunks" and not rows["e.md"].ok
    assert rows["a.md"].coverage == 1.0 and rows["c.md"].coverage == 1.0 and rows["f.md"].coverage == 1.0 and rows["a.md"].ok
    every = notes(spark, SMALL)
    assert C.coverage(every, C.structure_chunks(every)).where("coverage < 0.999 AND source_chars > 0").count() == 0


def test_problems_are_named(spark):
    note = spark.createDataFrame([("big", "x" * 1200), ("tiny", "y" * 900)], "path string, text string")
    chunk = [("big", 0, 0, "x" * 900, 0, 900)] + [("tiny", i, 0, "y" * 30, 30 * i, 30 * i + 30) for i in range(12)]
    rows = {r.path: r for r in C.validation(note, spark.createDataFrame(chunk, "path string, block int, piece int, content string, start int, end int")).collect()}
    assert rows["big"].problems == "single_chunk_for_large_document|chunk_exceeds_hard_bound" and rows["big"].warnings == "coverage_below_95_percent"
    assert rows["tiny"].problems == "too_many_tiny_chunks|all_chunks_far_below_target" and rows["tiny"].coverage == 0.4


def test_bucket_entries_are_chunked_alone(spark):
    text = "---\nbucket: true\n---\n# s\n\n## mem-aaa\n> importance=3 | tags=t, u\n\nFirst entry. " + "a b. " * 200 + "\n\n## mem-bbb\n> tags=v\n\n  - nested\n    more\n\n## mem-aaa\nrepeat"
    rows = C.bucket_chunks(spark.createDataFrame([("s.md", text)], "path string, text string")).orderBy("block", "piece").collect()
    assert {r.anchor for r in rows} == {"mem-aaa", "mem-bbb", "mem-aaa:d1"} and [r.tags for r in rows if r.anchor == "mem-aaa"][0] == ["t", "u"]
    assert all("importance=" not in r.content and r.ref.startswith(f"s.md#{r.anchor}:ch") for r in rows)
    assert "\n".join(r.content for r in rows if r.anchor == "mem-bbb") == "  - nested\n    more"
    for r in rows:
        assert squeezed(r.content) == squeezed(text[r.start : r.end])
