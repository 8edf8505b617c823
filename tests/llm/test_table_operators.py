"""Operators over whole tables: repeats, mixing, URL rules, shards, decontamination, the pipeline."""

import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from corpusmill.llm import queries as Q
from corpusmill.llm.common import small_table
from corpusmill.llm.decontaminate import contaminated_documents
from corpusmill.llm.mixing import MixTarget, mix_sources
from corpusmill.llm.neardup import near_duplicates
from corpusmill.llm.quality import quality_rules
from corpusmill.llm.repeats import repeated_passages, tuned_bands, without_repeats
from corpusmill.llm.sharding import place_rows, shard_documents
from corpusmill.llm.urlfilter import judge_urls
from tests.llm.brute import blank_words, by_key, components, contaminated, near_components, shingles
from tests.oracle import connection, difference


def test_repeats_equal_all_pairs(spark, documents):
    places = [(r.doc_id, k, line) for r in documents.collect() for k, line in enumerate(r.text.split("\n")) if len(blank_words(line)) >= 20]
    sets = [shingles(line, 5) for _, _, line in places]
    by_word = defaultdict(list)
    links = []
    for i, s in enumerate(sets):
        for j in {j for g in s for j in by_word[g]}:
            both = len(s & sets[j])
            if 100 * both >= 80 * (len(s) + len(sets[j]) - both):
                links.append((i, j))
        for g in s:
            by_word[g].append(i)
    groups = defaultdict(list)
    for i, c in components(links, range(len(places))).items():
        groups[c].append(places[i][:2])
    want = sorted((d, p, min(g), (d, p) != min(g)) for g in groups.values() if len(g) > 1 for d, p in g)
    want = [(d, p, f[0], gone) for d, p, f, gone in want]
    rows = repeated_passages(documents, recall=0.9999).where("paragraph IS NOT NULL").collect()
    assert sorted((r.doc_id, r.paragraph, r.first_doc_id, r.removed) for r in rows) == want and want


def test_passages_inside_lines_are_found_and_common_lines_left(spark):
    import random

    rng = random.Random(9)
    words = lambda n: [f"v{rng.randrange(10**6)}" for _ in range(n)]
    passages = [words(51) for _ in range(40)]
    common = " ".join(words(13))
    rows = []
    for i in range(400):
        text = words(rng.randint(30, 90))
        if i < 200:
            at = rng.randrange(len(text))
            text[at:at] = passages[i % 40]
        rows.append((i, f"{common}\n{' '.join(text)}\n{common}"))
    got = {r.doc_id for r in repeated_passages(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got <= set(range(200)) and len(got) >= 190


def test_repeats_edges(spark, edge_docs, no_docs):
    rows = repeated_passages(edge_docs.where("doc_id <> 8")).collect()
    assert {r.doc_id for r in rows} == {1, 2} and sorted(r.doc_id for r in rows if not r.removed and r.paragraph is not None) == [1, 1]
    assert repeated_passages(no_docs).count() == 0
    assert tuned_bands(0.8) == (11, 4)


def test_removed_paragraphs_leave_the_text(spark):
    line = " ".join(f"w{i}" for i in range(30))
    docs = spark.createDataFrame([(1, f"a\n{line}\nb"), (2, f"{line}\nc"), (3, "d")], "doc_id long, text string")
    assert {r.doc_id: r.text for r in without_repeats(docs, repeated_passages(docs)).collect()} == {1: f"a\n{line}\nb", 2: "c", 3: "d"}


def test_mixing_keeps_the_limit_and_every_document(spark, documents):
    out = mix_sources(documents, MixTarget(repeats=2.0)).cache()
    size = {r.doc_id: (r.source, len(blank_words(r.text))) for r in documents.collect()}
    total, drawn = Counter(), Counter()
    for s, n in size.values():
        total[s] += n
    picks = [(r.doc_id, r.mix_epoch) for r in out.collect()]
    assert len(picks) == len(set(picks)) and {d for d, _ in picks} == set(size)
    for d, _ in picks:
        drawn[size[d][0]] += size[d][1]
    longest = max(n for _, n in size.values())
    assert all(total[s] <= drawn[s] <= 2.0 * total[s] + longest for s in total)
    weights = {r.source: r.mix_weight for r in out.select("source", "mix_weight").distinct().collect()}
    assert sum(weights.values()) == pytest.approx(1)
    assert len(set(map(lambda s: round(weights[s] / total[s] ** 0.5, 12), weights))) >= 1
    unit = max(total[s] / weights[s] for s in weights)
    for s in weights:
        assert unit * weights[s] - longest <= drawn[s] <= unit * weights[s] + 1


def test_mixing_to_an_entropy_within_a_budget(spark, documents):
    import math

    out = mix_sources(documents, MixTarget(repeats=None, entropy=2.99, budget=400_000)).cache()
    weights = {r.source: r.mix_weight for r in out.select("source", "mix_weight").distinct().collect()}
    assert -sum(w * math.log(w) for w in weights.values()) == pytest.approx(2.99, abs=0.01)
    n = sum(len(blank_words(r.text)) for r in out.collect())
    assert n <= 400_000


def test_mixing_edges(spark, edge_docs, no_docs):
    docs = edge_docs.select("doc_id", "text", "lang", "source", "n_chars")
    once = mix_sources(docs, MixTarget(repeats=1.0))
    assert once.where("mix_epoch = 0").count() == docs.count()
    assert mix_sources(no_docs).count() == 0


def test_url_rules_equal_sql(spark, sf):
    assert difference(Q.op6_url_filters(spark, sf), Q.URL_SQL, connection(sf)) == ""


def test_url_edges(spark):
    urls = [None, "", "no scheme", "http://", "http://A.Example.COM", "x://u@www.example.com:80/en/a", "http://www.example.com/en/x?u=http://b", "http://net/es/#a", "http://a.net./es/", "http://com/", "http://xcom/", "http://com?q/", "HTTP://WWW.EXAMPLE.COM/EN/"]
    pages = spark.createDataFrame([(i, u) for i, u in enumerate(urls)] + [(9, urls[9]), (None, urls[7])], "page_id long, url string").withColumn("rule", F.lit("clash"))
    rules = small_table(spark, Q.URL_RULES, "host string, path string, action string")
    plain = []
    for r in pages.collect():
        rest = r.url.split("://", 1)[1] if r.url and "://" in r.url else ""
        cut = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
        host, tail = rest[:cut].lower(), rest[cut:]
        path = tail[: min([tail.find(c) for c in "?#" if c in tail], default=len(tail))]
        fits = [(len(h + p), h + p, a) for h, p, a in Q.URL_RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
        best = max(fits, default=(0, None, "allow"))
        plain.append((r.page_id, host, path, best[1], best[2]))
    assert by_key(judge_urls(pages, rules).collect()) == by_key(plain)
    assert judge_urls(pages.limit(0), rules).count() == 0 and judge_urls(pages, rules.limit(0)).where("verdict <> 'allow'").count() == 0


@pytest.mark.parametrize("law", ["bytes", "rows"])
def test_shards(spark, documents, law):
    rows = shard_documents(documents, 6, law).collect()
    text = {r.doc_id: r.text.encode() for r in documents.collect()}
    assert sorted(r.doc_id for r in rows) == sorted(text)
    assert all((r["size"], r.text_crc32) == (len(text[r.doc_id]) + 8, zlib.crc32(text[r.doc_id])) for r in rows)
    shards = defaultdict(list)
    for r in rows:
        shards[r.shard].append(r)
    assert sorted(shards) == list(range(6)) and all(sorted(r.slot for r in s) == list(range(len(s))) for s in shards.values())
    weight = [sum(r["size"] for r in s) if law == "bytes" else len(s) for s in shards.values()]
    assert max(weight) - min(weight) <= (2 * max(r["size"] for r in rows) if law == "bytes" else 1)


def test_shard_edges(spark, edge_docs, no_docs):
    assert shard_documents(edge_docs).count() == edge_docs.count() and shard_documents(no_docs).count() == 0
    copies = spark.range(400).select(F.col("id").alias("doc_id"), F.lit("same text").alias("text"), F.lit("en").alias("lang"), F.lit("s").alias("source"))
    sizes = [r["count"] for r in shard_documents(copies, 8).groupBy("shard").count().collect()]
    assert len(sizes) == 8 and max(sizes) - min(sizes) <= 2
    assert place_rows(copies, 4).columns == [*copies.columns, "shard", "slot"]


def columns(rows):
    return [(r.doc_id, r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in rows]


def test_decontamination_equals_brute_force(spark, documents, sf):
    items = spark.read.parquet(f"{sf}/benchmark.parquet")
    got = columns(contaminated_documents(documents, items).collect())
    want = contaminated([(r.doc_id, r.text) for r in documents.collect()], [tuple(r) for r in items.collect()])
    assert sorted(got) == sorted(want) and any(r[-1] for r in want)


def test_decontamination_edges(spark, edge_docs, no_docs):
    items = [(1, "fox jumps over the lazy dog and runs away from the old"), (2, "one two"), (3, ""), (None, "the quick brown"), (4, None), (2, "É é ß"), (5, "absent words here"), (6, "w1 w2 w3 w4 w5 w6 w7 w8 w9 w10 w11")]
    frame = spark.createDataFrame(items, "item_id long, text string").withColumn("key", F.lit(1))
    got = columns(contaminated_documents(edge_docs, frame).collect())
    want = contaminated([(r.doc_id, r.text) for r in edge_docs.collect()], items)
    assert by_key(got) == by_key(want)
    assert contaminated_documents(no_docs, frame).count() == 0
    assert contaminated_documents(edge_docs, frame.limit(0)).where("contaminated").count() == 0


def test_near_matches_are_told(spark):
    words = [f"t{i}" for i in range(12)]
    changed = words[:4] + ["x"] + words[5:]
    docs = spark.createDataFrame([(1, " ".join(changed)), (2, " ".join(words)), (3, "t4 " * 9)], "doc_id long, text string")
    items = spark.createDataFrame([(1, " ".join(words))], "item_id long, text string")
    rows = {r.doc_id: (r.contaminated, r.near_items) for r in contaminated_documents(docs, items).collect()}
    assert rows == {1: (False, 1), 2: (True, 0), 3: (False, 0)}


def test_pipeline_stages_against_brute_force(spark, documents, sf):
    docs, out = documents.select(corpus_pipeline.COLUMNS), {}
    for name, stage in corpus_pipeline.STAGES:
        before, docs = docs, stage(spark, docs, sf).cache()
        out[name] = (before.collect(), docs.collect())
    before, after = out["quality rules"]
    kept = {r.doc_id for r in quality_rules(documents).where("kept").collect()}
    assert {r.doc_id for r in after} == kept and all(len(r.text) == r.n_chars for r in after)
    before, after = out["near-duplicates"]
    want = {c for _, c in near_components([(r.doc_id, r.text) for r in before], 5, 80).values()}
    assert {r.doc_id for r in after} == want and len(after) == len(want)
    before, after = out["decontamination"]
    items = [tuple(r) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    bad = {r[0] for r in contaminated([(r.doc_id, r.text) for r in before], items) if r[-1]}
    assert {r.doc_id for r in after} == {r.doc_id for r in before} - bad
    before, after = out["mixing"]
    assert {r.doc_id for r in after} == {r.doc_id for r in before} and len(after) >= len(before)
    before, after = out["sharding"]
    assert by_key([r[:5] for r in map(tuple, after)]) == by_key([tuple(r) for r in before])
    assert {r.shard for r in after} <= set(range(24))


def test_pipeline_edges(spark, edge_docs, no_docs, sf):
    for docs in (edge_docs.where("doc_id <> 8 OR doc_id IS NULL"), no_docs):
        docs = docs.select(corpus_pipeline.COLUMNS)
        for _, stage in corpus_pipeline.STAGES:
            docs = stage(spark, docs, sf).cache()
        docs.count()


def test_near_duplicates_of_nothing(spark, no_docs):
    assert near_duplicates(no_docs).count() == 0
