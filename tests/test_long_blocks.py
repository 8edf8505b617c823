"""Lists, tables and code over the hard bound are cut where their kind allows."""

from pyspark.sql import functions as F

from corpusmill.operators import chunking as C


def pieces(spark, kind, text, limit):
    frame = spark.createDataFrame([(kind, text)], "kind string, text string")
    return frame.select(C.block_pieces(F.col("kind"), F.col("text"), limit).alias("p")).first().p


def texts(spark, kind, text, limit):
    return [p.t for p in pieces(spark, kind, text, limit)]


def test_lists_are_cut_at_items(spark):
    items = [f"- item {i} " + "x" * (i * 7 % 40) + ("\n  - inner" if i % 3 == 0 else "") for i in range(30)]
    got = texts(spark, "list", "\n".join(items), 120)
    assert "\n".join(got) == "\n".join(items) and all(len(p) <= 120 and p.startswith("- item") for p in got) and len(got) > 5


def test_tables_repeat_their_head(spark):
    head, rows = "| a | b |\n|---|:-:|", [f"| {i} | {'y' * (i % 30)} |" for i in range(40)]
    got = texts(spark, "table", head + "\n" + "\n".join(rows), 150)
    assert all(p.startswith(head + "\n") and len(p) <= 150 for p in got)
    assert [r for p in got for r in p[len(head) + 1 :].split("\n")] == rows


def test_code_is_opened_and_closed(spark):
    lines = [f"call({i})" + " " * (i % 5) + "#" * (i % 20) for i in range(60)]
    for closing in ("\n```", ""):
        got = texts(spark, "fence", "```py\n" + "\n".join(lines) + closing, 100)
        assert all(p.startswith("```py\n") and p.endswith("\n```") and len(p) <= 100 for p in got)
        assert [r for p in got for r in p[6:-4].split("\n")] == lines


def test_short_blocks_and_long_lines(spark):
    assert texts(spark, "list", "- a\n- b", 100) == ["- a\n- b"]
    assert texts(spark, "callout", "> " + "z" * 250, 100) == ["> " + "z" * 98, "z" * 100, "z" * 52]
    note = spark.createDataFrame([("n.md", "# H\n\n" + "\n".join(f"- item {i} " + "w" * 60 for i in range(40)))], "path string, text string")
    rows = C.structure_chunks(note).where("kind = 'list'").collect()
    assert len(rows) > 2 and all(len(r.content) <= C.HARD and r.content.startswith("- item") for r in rows)
