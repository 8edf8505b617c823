import pytest
from pyspark.sql import functions as F

from corpusmill.functions import text as T
from corpusmill.functions import web as W
from corpusmill.operators import governance as G


def one(spark, column, **values):
    row = spark.createDataFrame([tuple(values.values())], list(values))
    return row.select(column.alias("x")).first()["x"]


@pytest.mark.parametrize(
    ("text", "tokens"),
    [
        ("MySQL 知识", {"mysql", "知", "识", "知识"}),
        ("see notes/plan.md now", {"see", "notes", "plan.md", "plan", "now"}),
        ("a.b-c d_e", {"a.b-c", "d_e"}),
        ("", set()),
    ],
)
def test_index_tokens(spark, text, tokens):
    assert set(one(spark, T.index_tokens(F.col("t")), t=text)) == tokens


def test_ranking_tokens_drop_single_characters_of_longer_queries(spark):
    assert set(one(spark, T.ranking_tokens(T.index_tokens(F.col("t"))), t="MySQL 知识")) == {"mysql", "知识"}
    assert set(one(spark, T.ranking_tokens(T.index_tokens(F.col("t"))), t="库")) == {"库"}


def test_retrieval_terms(spark):
    assert one(spark, T.retrieval_terms(F.col("t")), t="检索系统设计 plan.md") == ["检索系统", "索系统设", "系统设计", "检索", "索系", "系统", "统设", "设计", "plan.md"]


@pytest.mark.parametrize(
    ("ref", "key"),
    [
        ("a/b.md#mem-1f:ch0123abcd", "a/b.md#mem-1f"),
        ("a/b.md#mem-1f:ch0123abcd-2", "a/b.md#mem-1f"),
        ("a/b.md#c12", "a/b.md"),
        ("a/b.md#doc:ch0123abcd", "a/b.md"),
        ("a/b.md", "a/b.md"),
        ("a\\b.md#x:c3", "a/b.md#x"),
    ],
)
def test_entry_key(spark, ref, key):
    assert one(spark, T.entry_key(F.col("r")), r=ref) == key


def test_fnv1a(spark):
    def plain(s):
        h = 2166136261
        for ch in s:
            h = ((h ^ ord(ch)) * 16777619) & 0xFFFFFFFF
        return f"{h:08x}"

    assert one(spark, T.fnv1a32(F.col("s")), s="artifact/a") == plain("artifact/a")


def test_redaction(spark):
    secrets = {
        '{"api_key": "skvABCDEF123456", "model": "m"}': "skvABCDEF123456", r'{\"password\": \"hunter2hunter2\"}': "hunter2hunter2", "cookie=abcdef1234567890; path=/": "abcdef1234567890",
        '{"Authorization": "Bearer sk-secret_12-3"}': "sk-secret_12-3", "key sk-ab_c-d9 end": "sk-ab_c-d9", "Bearer abc.def.ghi": "abc.def.ghi", "x-api-key: 123": "123",
        "ACCESS-TOKEN = AbCd1234+/=": "AbCd1234", "mail a.b@c.de": "a.b@c.de", 'SECRET:"0123456789"': "0123456789",
    }
    rows = spark.createDataFrame(list(secrets.items()), "s string, secret string")
    for r in rows.select("secret", T.redact(F.col("s")).alias("x")).collect():
        assert r.secret not in r.x and ("[REDACTED]" in r.x or "[EMAIL]" in r.x)
    for plain in ("the secret garden", "a token of thanks", "password: short", "key notes"):
        assert one(spark, T.redact(F.col("s")), s=plain) == plain


def test_truncation(spark):
    got = one(spark, T.head_and_tail(F.col("s"), 20, 5), s="a" * 15 + "b" * 20)
    assert got == "a" * 15 + "\n…[truncated 15 chars]…\n" + "b" * 5


def test_urls(spark):
    assert one(spark, W.canonical_url(F.col("u")), u="https://www.Example.com/A/b/?utm=1#x") == "example.com/a/b"
    assert W.glob_pattern("a/**/b*.md") == "a/.*/b[^/]*.md"


@pytest.mark.parametrize(
    ("status", "start", "end", "due", "reason"),
    [
        ("active", None, None, None, None),
        ("active", "2025-02-01", None, None, "not_yet_valid"),
        ("active", None, "2024-12-31", None, "status:expired"),
        ("active", None, None, "2024-12-31", "review_due"),
        ("archived", None, None, None, "status:archived"),
        (None, None, None, None, None),
    ],
)
def test_reject_reason(spark, status, start, end, due, reason):
    row = spark.createDataFrame([(status, start, end, due)], "s string, a string, b string, c string")
    day = lambda c: F.col(c).cast("timestamp")
    now = F.lit("2025-01-01").cast("timestamp")
    assert row.select(G.reject_reason(F.col("s"), day("a"), day("b"), day("c"), now)).first()[0] == reason


def test_scope(spark):
    match = lambda p, s: one(spark, G.scope_matches(F.col("p"), F.col("s"), "p1", "s1"), p=p, s=s)
    assert match("p1", "s1") and match("default", "") and match("", "s1")
    assert not match("p2", "s1") and not match("p1", "s2")


def test_write_decisions(spark):
    row = spark.createDataFrame([("core", False, "web", "remember this token"), ("core", False, "model", "x"), ("fact", True, "user", "x"), ("core", False, "user", "x")], "k string, h boolean, s string, c string")
    status, reasons = G.write_decision(F.lit(None).cast("string"), F.col("k"), F.col("h"), F.col("s"), F.col("c"))
    assert [tuple(r) for r in row.select(status, reasons).collect()] == [
        ("quarantine", ["external_instruction_or_secret"]), ("candidate", ["core_requires_confirmation"]),
        ("candidate", ["hypothesis_requires_confirmation"]), ("active", []),
    ]


def test_entities_of_a_long_text_are_searched_once(spark):
    """A turn with thousands of names takes no search of the whole turn for each of them."""
    import time

    from corpusmill.functions import queries

    text = " ".join(f"name_{i % 1500}" for i in range(3000))
    rows = spark.createDataFrame([(text,)] * 4, "t string").select(queries.kept_entities(F.col("t")).alias("e"))
    rows.where("size(e) < 0").count()
    began = time.monotonic()
    assert [len(r.e) for r in rows.collect()] == [24] * 4
    assert time.monotonic() - began < 10
