import json
import os

from pyspark.sql import functions as F

from corpusmill.operators import chunking as C
from corpusmill.operators import evaluation as E
from corpusmill.operators import fusion, graph, selection
from corpusmill.operators.similarity import jaccard_pairs
from corpusmill.sources import notes as N
from corpusmill.streaming import streams as S

NOTE = """---
title: Plan
tags: [a, b]
---
# One

Alpha beta. Gamma delta.

## Two
- item 1
- item 2

```py
# not a heading
x = 1
```

| a | b |
|---|---|
| 1 | 2 |

> [!note] callout
> more

tail paragraph
"""


def test_blocks_and_heading_paths(spark):
    notes = spark.createDataFrame([("n.md", NOTE)], "path string, text string")
    rows = C.blocks(notes).orderBy("block").collect()
    assert [r.kind for r in rows] == ["heading", "paragraph", "heading", "list", "fence", "table", "callout", "paragraph"]
    assert rows[1].heading_path == ["One"] and rows[-1].heading_path == ["One", "Two"]
    assert rows[4].text.startswith("```py\n# not a heading")


def test_chunk_ids_are_stable_and_bounded(spark):
    long = "Word here. " * 200
    first = spark.createDataFrame([("n.md", f"# A\n\n{long}\n\n# B\n\nshort text")], "path string, text string")
    second = spark.createDataFrame([("n.md", f"# New\n\nunrelated\n\n# A\n\n{long}\n\n# B\n\nshort text")], "path string, text string")
    a, b = (C.structure_chunks(x).collect() for x in (first, second))
    assert {r.ref for r in a} <= {r.ref for r in b} and len({r.ref for r in b}) == len(b)
    assert all(len(r.content) <= C.HARD and len(r.indexed) <= C.HARD for r in b)
    text = "".join("".join(r.content for r in sorted(a, key=lambda r: (r.block, r.piece))).split())
    assert text == "".join(f"# A{long}# Bshort text".split())


def test_merge_puts_headings_before_their_text(spark):
    notes = spark.createDataFrame([("n.md", "# A\n\ntext one\n\n# B\n\nother")], "path string, text string")
    merged = C.merged_chunks(C.structure_chunks(notes)).orderBy("block").collect()
    assert [r.content for r in merged] == ["# A\ntext one", "# B\nother"]


def test_paragraph_chunks(spark):
    notes = spark.createDataFrame([("n", "a" * 300 + "\n\n" + "b" * 290 + "\n\n" + "c" * 700)], "path string, text string")
    assert [len(r.content) for r in C.paragraph_chunks(notes).orderBy("chunk_index").collect()] == [591, 600, 100]


def test_route_ranks_prefer_body_text_and_fuse(spark):
    rows = [("q", "l", 1, "x", True), ("q", "l", 2, "y", False), ("q", "l", 3, "x", False), ("q", "v", 1, "y", False)]
    ranked = fusion.route_ranks(spark.createDataFrame(rows, "query_id string, route string, rank int, key string, heading_only boolean"))
    assert {(r.route, r.key): r.rank for r in ranked.collect()} == {("l", "x"): 1, ("l", "y"): 2, ("v", "y"): 1}
    fused = fusion.reciprocal_rank_fusion(ranked, 8).orderBy("rank").collect()
    assert [(r.key, r.score) for r in fused] == [("y", round(1 / 62 + 1 / 61, 6)), ("x", round(1 / 61, 6))]


def test_metrics_on_known_orders(spark):
    qrels = spark.createDataFrame([("t", "a", 2), ("t", "b", 1)], "task_id string, ref string, grade int")
    runs = [("t", "good", i, r) for i, r in enumerate("abc", 1)] + [("t", "back", i, r) for i, r in enumerate("cba", 1)] + [("none", "good", 1, "z")]
    got = E.task_metrics(spark.createDataFrame(runs, "task_id string, route string, rank int, ref string"), qrels, ["good", "back"])
    by = {(r.task_id, r.route): r for r in got.collect()}
    assert (by["t", "good"].ndcg, by["t", "good"].map, by["t", "good"].mrr) == (1.0, 1.0, 1.0)
    assert by["t", "back"].ndcg < 1 and by["t", "back"].mrr == 0.5
    assert by["none", "good"].recall == 0.0 and by["none", "back"].recall == 1.0


def test_links_resolve_by_path_then_name(spark):
    notes = spark.createDataFrame([("a/x.md", "[[b/y]] [[Z|alias]] [[gone#h]]"), ("b/y.md", ""), ("c/z.md", "[[x]]")], "path string, text string")
    edges = graph.resolve_links(graph.wikilinks(notes), notes)
    assert {(r.src, r.link, r.dst) for r in edges.collect()} == {
        ("a/x.md", "b/y", "b/y.md"), ("a/x.md", "Z", "c/z.md"), ("a/x.md", "gone", None), ("c/z.md", "x", "a/x.md"),
    }
    h = graph.health(notes.select(F.col("path").alias("node")), edges).first()
    assert (h.nodes, h.links, h.broken, h.orphans, h.score) == (3, 4, 1, 0, 0.75)


def test_jaccard_pairs_equal_brute_force(spark):
    import random

    rng = random.Random(5)
    sets = [(i, sorted(rng.sample(range(12), rng.randint(1, 9)))) for i in range(60)]
    got = {(r.left_id, r.right_id) for r in jaccard_pairs(spark.createDataFrame(sets, "id int, tokens array<int>"), 0.7).collect()}
    want = {(a, b) for a, x in sets for b, y in sets if a < b and len(set(x) & set(y)) > 0.7 * len(set(x) | set(y))}
    assert got == want and want


def test_packing_respects_both_budgets(spark):
    rows = [(1, 1, True, 0, 0.1, "a", 50), (1, 2, False, 5, 0.9, "a", 60), (1, 3, False, 5, 0.8, "b", 40), (1, 4, False, 1, 0.7, "b", 30)]
    frame = spark.createDataFrame(rows, "request int, id long, required boolean, priority int, score double, zone string, tokens int")
    assert [r.id for r in selection.packed_context(frame, 125, 100).orderBy("place").collect()] == [1, 3, 4]


def test_required_groups_come_first(spark):
    rows = spark.createDataFrame([(1, r, i) for i, r in enumerate("abcde", 1)], "query_id int, ref string, rank int")
    groups = spark.createDataFrame([(1, 0, "d"), (1, 1, "d"), (1, 1, "e")], "query_id int, group_no int, ref string")
    assert [r.ref for r in selection.covered_groups(rows, groups, 3).orderBy("place").collect()] == ["d", "e", "a"]


def test_word_changes_and_citations(spark):
    pair = spark.createDataFrame([(1, "a b c d", "a x c d e")], "id int, old string, new string")
    assert tuple(selection.word_changes(pair).first()) == (1, 3, 1, 2)
    answers = spark.createDataFrame([(1, "so [2] and `[3]` [[n#a]] [2]")], "id int, answer string")
    assert [r.ref for r in selection.citations(answers).orderBy("place").collect()] == ["2", "n#a"]


def test_note_scan_and_frontmatter(spark, tmp_path):
    for path, text in (("a/x.md", NOTE), (".obsidian/y.md", "no"), ("b/z.txt", "no"), ("b/w.md", "plain")):
        os.makedirs(tmp_path / os.path.dirname(path), exist_ok=True)
        (tmp_path / path).write_text(text)
    notes = N.scan_notes(spark, str(tmp_path))
    assert sorted(r.path for r in notes.collect()) == ["a/x.md", "b/w.md"]
    got = N.with_frontmatter(notes.where("path = 'a/x.md'")).first()
    assert got.meta["title"] == "Plan" and got.tags == ["a", "b"] and got.body.startswith("# One")
    assert [r.path for r in N.scan_notes(spark, str(tmp_path), ["b"]).collect()] == ["b/w.md"]


def test_torn_logs(spark, tmp_path):
    (tmp_path / "l.jsonl").write_text('{"a": 1}\n{"a": 2}\n{"a": \n{"a": 4}\n')
    assert [r.a for r in N.read_jsonl_until_bad(spark, str(tmp_path / "l.jsonl"), "a int").orderBy("at").collect()] == [1, 2]
    assert sorted(r.a for r in N.read_jsonl(spark, str(tmp_path / "l.jsonl"), "a int").collect()) == [1, 2, 4]


def test_compare_and_set(spark):
    import hashlib

    rev = hashlib.sha256(b"old").hexdigest()[:16]
    current = spark.createDataFrame([("a", "old"), ("b", "old")], "path string, content string")
    writes = spark.createDataFrame([("a", rev, "new"), ("b", "stale", "new"), ("c", None, "born")], "path string, expected string, content string")
    got = {r.path: (r.content, r.outcome) for r in N.compare_and_set(current, writes, "path").collect()}
    assert got == {"a": ("new", "written"), "b": ("old", "conflict"), "c": ("born", "written")}


def test_feed_items(spark):
    item = "<item><title>{t}</title><link>{l}</link><description><![CDATA[x <b>y</b>]]></description></item>"
    feeds = {
        "rss": '<?xml version="1.0"?><rss xmlns:dc="http://x"><channel><title>c</title>' + item.format(t="<![CDATA[A & B]]>", l=" http://a/b ") + item.format(t="", l="http://no") + item.format(t="no link", l="") + '<item><title type="x">T &amp; 2</title><link>http://b</link><pubDate> now </pubDate><dc:creator>z</dc:creator></item></channel></rss>',
        "bare": "<rss>" + item.format(t="T", l="http://one") + "</rss>",
        "rdf": '<rdf:RDF xmlns:rdf="http://r"><channel><title>c</title></channel>' + item.format(t="R", l="http://r") + "</rdf:RDF>",
        "atom": '<feed xmlns="http://www.w3.org/2005/Atom"><title>f</title><entry><title type="html">E1</title><link rel="alternate" href="http://c"/><link rel="self" href="http://s"/><summary>s1</summary><updated>2024</updated></entry><entry><title>E2</title></entry></feed>',
        "torn": "<rss><channel><item><title>x</title>", "none": None, "blank": "", "long": "<rss>" + item.format(t="L", l="http://l").replace("x <b>y</b>", "w" * 900) + "</rss>",
    }
    frame = spark.createDataFrame(list(feeds.items()), "url string, xml string")
    got = {}
    for r in N.feed_items(frame).orderBy("url", "place").collect():
        got.setdefault(r.url, []).append((r.title, r.link, r.text))
    assert got == {
        "rss": [("A & B", "http://a/b", "x y"), ("T & 2", "http://b", "")], "bare": [("T", "http://one", "x y")], "rdf": [("R", "http://r", "x y")],
        "atom": [("E1", "http://c", "s1")], "long": [("L", "http://l", "w" * 500)],
    }
    assert [r.url for r in N.broken_feeds(frame).collect()] == ["torn"]


def test_single_pages_as_feeds(spark):
    pages = spark.createDataFrame([
        ("u1", "n", "<html><head><title> Own </title><meta name='description' content='told'></head><body>text</body></html>"),
        ("u2", "name", "<script>no</script><p>some <b>words</b></p><style>no</style>"), ("u3", "", None), (None, "n", "x"),
    ], "url string, name string, html string")
    assert sorted((r.url, r.title, r.text) for r in N.page_item(pages).collect()) == [("u1", "Own", "told"), ("u2", "name", "some words"), ("u3", "link", "")]


def test_balanced_json(spark):
    import json

    from corpusmill.functions.text import balanced_json

    cases = {
        '{"a": 1}': {"a": 1}, '```json\n{"a": {"b": [1, 2]}}\n```': {"a": {"b": [1, 2]}}, 'said: {"a": "}{\\" ]"} and more }': {"a": '}{" ]'}, "[1, [2]] tail ]": [1, [2]],
        'first [1] then {"k": 2}': {"k": 2}, '{"a": 1': None, "no brackets": None, "": None, None: None, "{not json}": None, '{"a": 1}{"b": 2}': {"a": 1}, '{"a": "\\\\"} x': {"a": "\\"},
    }
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(cases)], "i int, t string").select("i", balanced_json(F.col("t")).alias("x")).orderBy("i").collect()
    assert [None if r.x is None else json.loads(r.x) for r in rows] == list(cases.values())


def test_queue_stream_equals_a_fold(spark, tmp_path):
    d = "/root/testdata/sf0.001"
    out = S.drained(S.task_states(S.timed(S.parquet_stream(spark, f"{d}/events.parquet"))), "queue_fold", "update")
    got = {r.user_id: (r.status, r.moves, r.ignored) for r in out.collect()}
    want = {}
    for r in spark.read.parquet(f"{d}/events.parquet").orderBy("ts", "event_id").collect():
        status, moves, ignored = want.get(r.user_id, ("", 0, 0))
        new = S.MOVES.get((status, r.event_type))
        want[r.user_id] = (new, moves + 1, ignored) if new else (status, moves, ignored + 1)
    assert got == want


def test_intake_appends_new_keys_once(spark, tmp_path):
    source, target = tmp_path / "in", str(tmp_path / "out")
    os.makedirs(source)
    for i, urls in enumerate((["a", "b"], ["b", "c"])):
        (source / f"{i}.json").write_text("\n".join(json.dumps({"url": u}) for u in urls))
    for _ in range(2):
        stream = spark.readStream.schema("url string").option("maxFilesPerTrigger", 1).json(str(source))
        S.intake(stream, target, ["url"], str(tmp_path / "ck")).awaitTermination()
    assert sorted(r.url for r in spark.read.parquet(target).collect()) == ["a", "b", "c"]


def test_bucket_entries(spark):
    from corpusmill.operators.buckets import bucket_entries

    text = "---\nbucket: true\n---\n# 2025-01\n\n## mem-1a\n\n> importance=8 | tags=a, b | created=2025-01-02 | project=p1\n\nbody one\n\n```\n## mem-ff\n```\n\n## mem-2b\nplain\n\n## mem-1a\nagain"
    rows = bucket_entries(spark.createDataFrame([("s.md", text)], "path string, text string")).orderBy("entry_index").collect()
    assert [(r.mem_id, r.anchor) for r in rows] == [("mem-1a", "mem-1a"), ("mem-2b", "mem-2b"), ("mem-1a", "mem-1a:d1")]
    assert (rows[0].importance, rows[0].tags, rows[0].project, rows[0].created.year) == (8, ["a", "b"], "p1", 2025)
    assert rows[0].content == "body one\n\n```\n## mem-ff\n```" and rows[1].content == "plain"
