"""Very long texts, urls, pages and conversations, and the counts of whole long texts."""

from collections import Counter

import corpus_pipeline
from corpusmill.llm import queries as Q
from corpusmill.llm.chatformat import format_conversations, read_back
from corpusmill.llm.common import small_table
from corpusmill.llm.htmltext import extract_main_text
from corpusmill.llm.quality import quality_rules
from corpusmill.llm.tokenfiles import token_digests
from corpusmill.llm.urlfilter import judge_urls
from tests.llm.brute import blank_words
from tests.llm.test_text_operators import chat_digest, token_rows


def test_repeated_words_of_whole_texts(spark, documents, edge_docs):
    rows = documents.select("doc_id", "text").union(edge_docs.where("doc_id = 8").select("doc_id", "text")).collect()
    got = Counter((r.doc_id, r.n_words, r.n_repeat_words) for r in quality_rules(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    want = Counter()
    for r in rows:
        words = blank_words(r.text)
        grams = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
        again = Counter(grams)
        want[r.doc_id, len(words), len({i + k for i, g in enumerate(grams) if again[g] > 1 for k in range(3)})] += 1
    assert got == want and max(n for _, n, _ in want) == 60_000


def test_long_text_has_the_library_s_ids(spark, edge_docs):
    import public_tokenizers

    path = public_tokenizers.path("word_bpe_49k.json")
    long = edge_docs.where("doc_id IN (8, 9)")
    got = [tuple(r) for r in token_digests(long, path).orderBy("start").collect()]
    assert got == token_rows(path, [(r.doc_id, r.text) for r in long.orderBy("doc_id").collect()])


def test_long_urls_and_pages(spark):
    path = "/en/" + "a/" * 50_000
    pages = spark.createDataFrame([(i, f"http://{h}{path}", f"<nav>x</nav><p>{'word ' * 90_000}</p>") for i, h in enumerate(("www.example.com", "example.com", "a" * 9_000 + ".net"))], "page_id long, url string, html string")
    rows = {r.page_id: (r.rule, r.verdict, len(r.path)) for r in judge_urls(pages, small_table(spark, Q.URL_RULES, "host string, path string, action string")).collect()}
    assert rows == {0: ("www.example.com/en/", "allow", len(path)), 1: ("example.com/en/", "block", len(path)), 2: (None, "allow", len(path))}
    assert {r.n_chars for r in extract_main_text(pages).collect()} == {5 * 90_000 - 1}


def test_long_conversations(spark):
    turns = [("user" if i % 2 == 0 else "assistant", f"turn {i} </s> \\ " + "x" * (200_000 if i == 7 else 3)) for i in range(1500)]
    frame = spark.createDataFrame([(5, i, r, t) for i, (r, t) in enumerate(turns)], "conv_id long, turn long, role string, text string")
    assert [tuple(r)[1:] for r in read_back(format_conversations(frame)).collect()] == [chat_digest(turns)]


def test_pipeline_takes_long_texts(spark, edge_docs, sf):
    long = "\n".join(" ".join(f"w{k}x{i}" for i in range(40)) + "." for k in range(2_000))
    more = spark.createDataFrame([(20, long, "en", "c", len(long)), (21, long, "en", "c", len(long))], "doc_id long, text string, lang string, source string, n_chars long")
    docs = edge_docs.select(corpus_pipeline.COLUMNS).union(more)
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, sf).cache()
        assert 20 in {r.doc_id for r in docs.select("doc_id").collect()}
    assert [r.text for r in docs.where("doc_id IN (20, 21)").distinct().collect()] == [long]
