"""Every exact passage of 50 words has a run of equal segments."""

import numpy as np

from corpusmill.llm.repeats import MIN_RUN, segment_starts


def test_passages_of_50_words_have_a_run():
    rng = np.random.default_rng(3)
    for _ in range(3000):
        passage = rng.integers(0, 2**63, 50).astype(np.uint64)
        found = []
        for _ in range(2):
            before, after = (rng.integers(0, 2**63, rng.integers(0, 40)).astype(np.uint64) for _ in range(2))
            cuts = segment_starts(np.concatenate([before, passage, after])) - len(before)
            found.append({(a, b) for a, b in zip(cuts[:-1], cuts[1:]) if a >= 0 and b <= 50})
        run = best = 0
        for a, b in sorted(found[0] & found[1]):
            run = b - a if not best or a != end else run + b - a
            end, best = b, max(best, run)
        assert best >= MIN_RUN


def test_cuts_are_the_last_lowest_places():
    from corpusmill.llm.repeats import REACH
    from corpusmill.llm.shingles import MIX, mixed

    rng, width = np.random.default_rng(3), 2 * REACH - 1
    for n in (0, 1, width, width + 1, width + 2, 90):
        for kinds in (1, 2, 1 << 60):
            words = rng.integers(0, kinds, n, np.uint64)
            h = mixed(words[:-1] * MIX[3] + words[1:]).tolist()
            expected = {max(j for j in range(i, i + width) if h[j] == min(h[i : i + width])) for i in range(len(h) - width + 1)}
            assert segment_starts(words).tolist() == sorted(expected)


def test_documents_are_hashed_together(spark, monkeypatch):
    """The paragraphs' signatures are taken for many documents at once, with the same rows as one by one."""
    from corpusmill.llm import repeats

    texts = [" ".join(f"w{(i * j) % 97}" for j in range(30)) + "\nshort\n" + " ".join(f"v{(i + j) % 53}" for j in range(25)) for i in range(40)] + ["", None, "a"]
    docs = spark.createDataFrame([(i, i, t) for i, t in enumerate(texts)], "row_key long, doc_id long, text string").coalesce(1)
    got = []
    for words in (1, repeats.GROUP_WORDS):
        monkeypatch.setattr(repeats, "GROUP_WORDS", words)
        got.append(sorted(map(str, repeats.units(docs, 5, 20, 11, 4).drop("row").collect())))
    assert got[0] == got[1] and len(got[0]) > 100
