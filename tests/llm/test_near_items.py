"""Near matches of benchmark items against a plain statement of them."""

import math
import random

from corpusmill.llm.decontaminate import contaminated_documents


def near_items(rows, items, window=10, slack=3, share=0.8):
    out = {}
    for i, text in rows:
        w, n = text.split(), 0
        for _, t in items:
            t = t.split()
            span = min(window, len(t))
            wins = [t[k : k + span] for k in range(len(t) - span + 1)]
            exact = any(w[k : k + span] in wins for k in range(len(w)))
            bags = [set(w[k : k + span + 2 * slack]) for k in range(len(w))]
            n += not exact and any(len(set(x) & bag) >= math.ceil(share * len(set(x))) for x in wins for bag in bags)
        out[i] = n
    return out


def compared(spark, rows, items):
    docs, tests = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    return {r.doc_id: r.near_items for r in contaminated_documents(docs, tests).collect()}, near_items(rows, items)


def test_the_rarest_term_may_be_replaced_or_moved(spark):
    words = [f"t{i}" for i in range(10)]
    rows = [
        (1, " ".join(["t4x" if x == "t4" else x for x in words])), (2, " ".join(words[:4] + ["new"] + words[4:7] + ["one"] + words[7:])),
        (3, "t0 t1 t2 t3 t5 t6 t7 t8 " * 3), (4, " ".join(["a"] * 170 + words[:4] + ["b"] + words[6:])), (5, " ".join(words[:7] + ["x"] * 40)),
    ]
    got, want = compared(spark, rows, [(1, " ".join(words))])
    assert got == want == {1: 1, 2: 1, 3: 1, 4: 1, 5: 0}


def test_near_items_equal_brute_force(spark):
    rng = random.Random(4)
    items = [(i, " ".join(f"w{int(rng.paretovariate(0.6))}" for _ in range(rng.choice([1, 4, 9, 10, 14, 25])))) for i in range(12)]
    rows = []
    for i in range(150):
        text = [f"w{int(rng.paretovariate(0.6))}" for _ in range(rng.randrange(400))]
        for _ in range(2):
            copy = rng.choice(items)[1].split()
            for _ in range(rng.randrange(5)):
                k = rng.randrange(len(copy))
                copy[k : k + rng.randrange(2)] = [f"n{rng.randrange(10**9)}"]
            at = rng.randrange(len(text) + 1)
            text[at:at] = copy
        rows.append((i, " ".join(text)))
    got, want = compared(spark, rows, items)
    assert got == want and sum(want.values()) > 50
