"""Operators on single documents, pages and conversations: quality, HTML, chat, token files."""

import hashlib
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from corpusmill.llm.chatformat import escape, format_conversations, read_back, render, unescape
from corpusmill.llm.htmltext import extract_main_text, fitted_weights, main_text
from corpusmill.llm.quality import LineRules, clean_documents, measure, quality_rules
from corpusmill.llm.queries import CONTROL_ROWS
from corpusmill.llm.tokenfiles import LENGTHS, decode_ranks, encode_ranks, token_digests
from tests.llm.brute import blank_words, by_key


def plain_counts(text):
    text = text or ""
    words = blank_words(text)
    lines, dup = set(), 0
    for line in text.split("\n"):
        dup += bool(blank_words(line)) and line in lines
        lines.add(line)
    grams = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    covered = {i + k for i, g in enumerate(grams) if grams.count(g) > 1 for k in range(3)} if len(grams) < 3000 else None
    return len(words), sum(map(len, words)), sum(text.count(s) for s in "#*$%&|<>"), dup, None if covered is None else len(covered)


def test_quality_counts(spark, documents):
    docs = documents.where("n_chars < 6000")
    got = {r.doc_id: r for r in quality_rules(docs).collect()}
    for d in docs.collect():
        r, (n, chars, symbols, dup, repeat) = got[d.doc_id], plain_counts(d.text)
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines) == (n, chars, symbols, dup)
        assert repeat is None or r.n_repeat_words == repeat
        assert r.base_failed == (n < 50 or 100 * r.n_repeat_words > 50 * n)


def test_quality_verdicts_follow_labels(spark, documents, sf):
    rows = quality_rules(documents).where("NOT base_failed").join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id")
    assert rows.where("kept <> (quality = 1)").count() == 0


def test_lines_go_and_documents_with_them():
    good = " ".join(f"Sentence {i} tells of thing{i} and of matter{i} at length{i}." for i in range(8))
    text = f"{good}\nHome | News | Sport | Contact\nAll rights reserved."
    kept, cleaned = measure(text, LineRules())[7:]
    assert kept and cleaned == good, cleaned
    assert not measure("\n".join(["Home | News | Sport | Contact | About | Jobs"] * 30), LineRules())[7]


def test_quality_edges(spark, edge_docs, no_docs):
    assert quality_rules(edge_docs).count() == edge_docs.count() and quality_rules(no_docs).count() == 0
    out = clean_documents(edge_docs.select("doc_id", "text", "lang", "source", "n_chars"))
    assert out.columns == ["doc_id", "text", "lang", "source", "n_chars"] and out.where("n_chars <> length(text)").count() == 0


PAGE = """<html><head><title>t</title></head><body><header>Site name here</header><nav><a href=x>home</a></nav><div class="side-bar sidebar">x y</div>
<article><h1>Title &amp; more</h1><p>First <b>bold</b>
 text&nbsp;here.</p><div class='newsletter'>join us</div><ul><li>one<li>two</ul><script>a < b</script></article>
<div id=comments><p>nice post</p></div><footer>&copy; us</footer></body></html>"""


def test_main_text():
    assert main_text(PAGE) == "Title & more\n\nFirst bold text here.\n\none\n\ntwo"
    assert main_text("") == "" and main_text("<nav>a b c</nav>") == "" and main_text("just text") == "just text"
    assert main_text("<p>a<b>c</b> d <") == "ac d <" and main_text("<p>cut off</p><a hre") == "cut off"


def test_weights_have_their_signs():
    weights = fitted_weights()
    assert weights["#word"] > 0 and all(v < 0 for k, v in weights.items() if k != "#word")


def test_pages(spark, sf):
    pages = spark.read.parquet(f"{sf}/pages.parquet")
    rows = extract_main_text(pages).collect()
    assert len(rows) == pages.count() and all(r.n_chars == len(r.text) for r in rows)
    odd = spark.createDataFrame([(1, None, None), (None, "u", PAGE), (2, "u", ""), (2, "u", "")], "page_id long, url string, html string").withColumn("text", F.lit(1))
    assert sorted(r.n_chars for r in extract_main_text(odd).collect()) == [0, 0, 0, len(main_text(PAGE))]
    assert extract_main_text(odd.limit(0)).count() == 0


@given(st.text(alphabet="[]/<>INST SYROLE\\s\n" + "é\ue000"))
@settings(max_examples=200, deadline=None)
def test_escapes_reverse(text):
    coded = escape(text)
    assert unescape(coded) == text
    assert not any(mark in coded for mark in ("[INST]", "[/INST]", "<s>", "</s>", "<<SYS>>", "<</SYS>>"))


def chat_digest(turns):
    text = "".join(f"{r}\n{t}\n" for r, t in turns)
    loss = "".join(t for r, t in turns if r == "assistant")
    whole = render([{"role": r, "text": t} for r, t in turns])
    return len(turns), hashlib.sha256(text.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest(), len(whole), False


def test_conversations_read_back(spark, sf):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    rows += CONTROL_ROWS + [(-2, None, None, None), (-2, 1, "to>ol", "x\\"), (-2, 1, "system", ""), (-2, 1, "system", ""), (None, 0, "assistant", " \ue000 ")]
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("piece", F.lit(0))
    got = {r[0]: tuple(r)[1:] for r in read_back(format_conversations(frame)).collect()}
    want = {}
    for conv, turn, role, text in sorted(rows, key=lambda r: (r[1] is not None, r[1] or 0, r[2] is not None, r[2] or "", r[3] or "")):
        want.setdefault(conv, []).append((role or "", text or ""))
    assert got == {c: chat_digest(t) for c, t in want.items()}
    assert read_back(format_conversations(frame.limit(0))).count() == 0


def test_templates_that_rewrite_history_are_found(spark):
    def thinking(messages):
        return "".join(f"<{m['role']}>" + (m["text"] if i == len(messages) - 1 else m["text"].replace("think", "")) for i, m in enumerate(messages))

    frame = spark.createDataFrame([(1, 0, "a", "think x"), (1, 1, "b", "y")], "conv_id long, turn long, role string, text string")
    assert [r.rewrites_history for r in format_conversations(frame, thinking).orderBy("n").collect()] == [False, True]


@pytest.mark.parametrize("counts", [[0], [1], [3, 0, 4], [5, 1000, 2]])
def test_ranks_round_trip(counts):
    counts = np.array(counts)
    ranks = (np.random.default_rng(7).pareto(0.3, counts.sum()) * 3).clip(0, 2**32 - 1).astype(np.uint32)
    control, data = encode_ranks(ranks, counts)
    assert [len(c) for c in control] == [-(-n // 4) for n in counts] and LENGTHS.shape == (256, 4)
    whole = [np.frombuffer(b"".join(x), np.uint8) for x in (control, data)]
    assert (decode_ranks(*whole, counts) == ranks).all()
    for c, d, r in zip(control, data, np.split(ranks, np.cumsum(counts)[:-1]), strict=True):
        assert (decode_ranks(np.frombuffer(c, np.uint8), np.frombuffer(d, np.uint8), np.array([len(r)])) == r).all()


def token_rows(path, rows):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path)
    start, out = 0, []
    for i, text in rows:
        ids = np.array(t.encode(text or "", add_special_tokens=False).ids + [1], "<u4")
        out.append((i, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    return out


def test_token_files_lie_in_the_order_of_ids(spark, documents, tmp_path):
    path = pytest.importorskip("public_tokenizers").path("word_bpe_49k.json")
    import glob

    import pyarrow.parquet as pq

    from corpusmill.llm.tokenfiles import write_token_files

    write_token_files(documents.repartition(5), f"file://{tmp_path}/files", path, 1)
    ids = [i for name in sorted(glob.glob(f"{tmp_path}/files/blocks/part-*.parquet")) for row in pq.read_table(name).column("doc_ids").to_pylist() for i in row]
    assert ids == sorted(r.doc_id for r in documents.collect())


def test_token_files(spark, documents, edge_docs, no_docs):
    path = pytest.importorskip("public_tokenizers").path("word_bpe_49k.json")
    got = [tuple(r) for r in token_digests(documents, path).orderBy("start").collect()]
    assert got == token_rows(path, sorted((r.doc_id, r.text) for r in documents.collect()))
    odd = edge_docs.where("doc_id IS NOT NULL AND doc_id <> 8")
    got = [tuple(r) for r in token_digests(odd, path).orderBy("start").collect()]
    assert got == token_rows(path, sorted(((r.doc_id, r.text) for r in odd.collect()), key=lambda r: r[0]))
    assert token_digests(edge_docs, path).count() == edge_docs.count()
    assert token_digests(no_docs, path).count() == 0


def test_whole_texts_encode_like_the_library():
    path = pytest.importorskip("public_tokenizers").path("word_bpe_49k.json")
    from corpusmill.llm.tokenfiles import WordCodec

    codec = WordCodec(path)
    texts = ["", "  ", "Don't I'LL 'S x''s 12ab ½ a²b", "<|endoftext|> hi", "a\x1cb\x85c\xa0d", "ÀÉß İ ŉ ǅ", "日本 語 café", "e\u0301 \u2018q\u2019"]
    texts.append(" ".join(chr(c) for c in range(0x20, 0x250) if c != 0x130))
    for _ in range(2):
        for some in (texts, [t for t in texts if "<" not in t and "\x1c" not in t][:3], [""]):
            ids, counts = codec.encode(some)
            for text, own in zip(some, np.split(ids, np.cumsum(counts)[:-1]), strict=True):
                assert own.tolist() == codec.whole_text(text)


def test_rows_are_whole(spark, edge_docs):
    assert by_key(quality_rules(edge_docs).select("doc_id").collect()) == by_key(edge_docs.select("doc_id").collect())
