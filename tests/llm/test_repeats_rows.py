"""Repeated and missing ids in the search for repeated passages, and runs against all pairs."""

import random
from collections import Counter

from corpusmill.llm.repeats import repeated_passages, segment_starts
from corpusmill.llm.shingles import WordHashes
from tests.llm.brute import by_key


def sentence(rng, n=30):
    return " ".join(f"w{rng.randrange(10**6)}" for _ in range(n))


def test_rows_with_one_id_are_judged_by_their_own_texts(spark):
    rng = random.Random(5)
    a, b, c = (sentence(rng) for _ in range(3))
    docs = spark.createDataFrame([(1, a), (1, f"{b}\n{c}"), (1, None), (2, b), (None, a), (None, c), (None, None)], "doc_id long, text string")
    rows = repeated_passages(docs).where("method = 'bands'").collect()
    got = by_key((r.doc_id, r.paragraph, r.first_doc_id, r.removed) for r in rows)
    assert got == by_key([(1, 0, 1, False), (None, 0, 1, True), (1, 0, 1, False), (2, 0, 1, True), (1, 1, 1, False), (None, 0, 1, True)])


def test_repeated_rows_go_together(spark):
    text = sentence(random.Random(6), 60)
    docs = spark.createDataFrame([(1, text)] * 4 + [(None, text)] * 2, "doc_id long, text string")
    for method in ("bands", "run"):
        rows = repeated_passages(docs).where(f"method = '{method}'").collect()
        assert len(rows) == 6 and [r.doc_id for r in rows if not r.removed] == [1] * 4


def test_long_texts_are_cut_whole(spark):
    rng = random.Random(7)
    passage = sentence(rng, 60)
    long = " ".join(f"x{i}" for i in range(70_000))
    docs = spark.createDataFrame([(1, f"{long} {passage}"), (2, f"{sentence(rng)} {passage} {sentence(rng)}")], "doc_id long, text string")
    rows = repeated_passages(docs).where("method = 'run'").collect()
    assert sorted(r.doc_id for r in rows) == [1, 2] and max(r.start for r in rows) >= 70_000 - 1


def test_runs_equal_all_segments(spark):
    rng = random.Random(8)
    parts = [sentence(rng, rng.randrange(5, 45)) for _ in range(12)]
    texts = [" ".join(rng.choice([rng.choice(parts), sentence(rng, 9)]) for _ in range(rng.randrange(1, 14))) for _ in range(60)]
    hashes, segments, seen = WordHashes(), {}, Counter()
    for i, t in enumerate(texts):
        words = t.encode().split()
        cuts = segment_starts(hashes.of(words)).tolist()
        segments[i] = [(s, e, tuple(words[s:e])) for s, e in zip(cuts[:-1], cuts[1:])]
        seen.update(w for _, _, w in segments[i])
    want = []
    for i, own in segments.items():
        run = None
        for s, e, w in [*own, (None, None, None)]:
            if w is not None and seen[w] > 1 and run and run[1] == s:
                run[1] = e
            else:
                if run and run[1] - run[0] >= 20:
                    want.append((i, run[0], run[1] - run[0]))
                run = [s, e] if w is not None and seen[w] > 1 else None
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = repeated_passages(docs).where("method = 'run'").collect()
    assert sorted((r.doc_id, r.start, r.n_words) for r in got) == sorted(want) and want
