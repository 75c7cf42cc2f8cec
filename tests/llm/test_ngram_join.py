import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyframe.llm import ngram_join
from tallyframe.llm.ngram_join import components_of, matches_wanted, one_of_each, stars


def brute(rows, words, percent):
    sets = []
    for _, text in rows:
        w = re.findall("[^\x20\x09-\x0d]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
        sets.append({tuple(w[i : i + words]) for i in range(len(w) - words + 1)} if len(w) >= words else {tuple(w)} if w else set())
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j]):
                root[find(i)] = find(j)
    least = {}
    for i, (k, _) in enumerate(rows):
        least[find(i)] = min(least.get(find(i), k), k)
    return sorted((k, len(sets[i]), least[find(i)]) for i, (k, _) in enumerate(rows))


def corpus(seed, n=260):
    rng = random.Random(seed)
    words = [f"w{k}" for k in range(400)]
    shared = " ".join(rng.choices(words, k=60))
    texts = []
    while len(texts) < n:
        kind = rng.random()
        base = [rng.choice(words) for _ in range(rng.choice([1, 2, 3, 12, 60, 150]))]
        if kind < 0.25 and texts:
            base = rng.choice(texts[:20] if rng.random() < 0.5 else texts).split()
            for _ in range(rng.choice([0, 1, 1, 2, 3])):
                if base:
                    base[rng.randrange(len(base))] = rng.choice(words)
        text = " ".join(base)
        if rng.random() < 0.1:
            text = shared + " " + text
        texts.append(text.upper() if rng.random() < 0.1 else text)
    ids = rng.sample(range(10_000), n)
    return list(zip(ids, texts)) + [(20_000, None), (20_001, ""), (20_002, "\t a\x0bB "), (20_003, "a b"), (20_004, "q " * 3000), (20_005, "q " * 2000)]


@pytest.mark.parametrize("words, percent, hubs, hot, bits", [(3, 90, 1, 20_000, 1 << 26), (5, 80, 2, 20_000, 1 << 26), (2, 50, 0, 20_000, 1 << 26), (3, 90, 1, 3, 1 << 8)])
def test_equals_brute_force(spark, monkeypatch, words, percent, hubs, hot, bits):
    monkeypatch.setattr(ngram_join, "HUB_ROUNDS", hubs)
    monkeypatch.setattr(ngram_join, "HOT", hot)
    monkeypatch.setattr(ngram_join, "FILTER_BITS", bits)
    rows = corpus(words)
    docs = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, cid int").repartition(4)
    got = sorted((r.doc_id, r.n_shingles, r.component_id) for r in components_of(docs, words, percent).collect())
    assert got == brute(rows, words, percent)


def test_edges(spark):
    docs = spark.createDataFrame([(4, "a b c d"), (4, "a b c d"), (None, "a b c d"), (None, "x y z"), (2, "e f g h"), (2, None)], "doc_id long, text string")
    got = sorted(((r.doc_id, r.n_shingles, r.component_id) for r in components_of(docs).collect()), key=str)
    assert got == sorted([(4, 2, 4), (4, 2, 4), (None, 2, 4), (None, 1, None), (2, 2, 2), (2, 0, 2)], key=str)
    assert components_of(docs.limit(0)).count() == 0
    rows = corpus(7)
    table = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, root string")
    kept = one_of_each(table)
    assert sorted(r.doc_id for r in kept.collect()) == sorted(k for k, _, c in brute(rows, 5, 80) if k == c) and kept.columns == table.columns


def test_stars_on_long_chains(spark):
    rng = random.Random(1)
    names = rng.sample(range(10_000), 300)
    edges = [(names[i], names[i + 1]) for i in range(199)] + [(names[i], names[i + 1]) for i in range(200, 299)]
    got = {r.cid: r.root for r in stars(spark.createDataFrame(edges, "a long, b long")).collect()}
    low, high = min(names[:200]), min(names[200:])
    assert all(got.get(x, x) == low for x in names[:200]) and all(got.get(x, x) == high for x in names[200:])


def test_costly_prefixes_ask_for_more_matches():
    bounds = np.array([0, 100, 200])
    cheap, dear = np.ones(100), np.concatenate([np.full(50, 900.0), np.full(50, 1000.0)])
    wanted = matches_wanted(np.concatenate([cheap, dear]), bounds, np.array([90, 90]))
    assert wanted[1] > 1 and wanted.min() >= 1


def test_one_large_component_and_an_outsider(spark):
    """A shingle of many sets that are connected already: only the outsider is compared with them."""
    base = [f"w{k}" for k in range(60)]
    rows = [(k, " ".join([*base, f"own{k}"])) for k in range(1, 120)] + [(900, " ".join(base[:58])), (901, " ".join(f"v{k}" for k in range(60)))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((r.doc_id, r.n_shingles, r.component_id) for r in components_of(docs).collect())
    assert got == brute(rows, 3, 90)


def test_sketches_are_added_in_rounds(spark, monkeypatch):
    docs = spark.createDataFrame([(k, f"a{k % 7} b c d{k}") for k in range(200)], "doc_id long, text string").repartition(11)
    survey = ngram_join.surveyed(docs, 3, 1, 1 << 22)
    at_once = ngram_join.merged_sketch(survey, 1 << 22)
    monkeypatch.setattr(ngram_join, "FAN_IN", 2)
    assert (ngram_join.merged_sketch(survey, 1 << 22) == at_once).all() and at_once.sum() == 400


def test_postings_of_a_hot_shingle_are_spread(spark):
    """A third of all postings at one shingle: no place of a join gets more than a fair piece of them, none is lost."""
    posts = spark.range(6000).selectExpr("if(id % 3 = 0, -1, id) as token", "id as cid", "id % 3 = 0 as hot")
    salted = ngram_join._salted(posts, "cid").groupBy("token", "salt").count()
    assert salted.agg({"count": "max"}).first()[0] < 2000 / ngram_join.HOT_SALTS * 2
    facts = posts.groupBy("token").agg(F.count("*").alias("size"), F.first("hot").alias("hot"))
    joined = ngram_join.with_shingle(posts, facts)
    assert joined.count() == 6000 and joined.filter("token = -1").agg(F.sum("size")).first()[0] == 2000**2
    hot = posts.filter("hot")
    left, right = ngram_join._pieces(hot.withColumnRenamed("cid", "x"), "x", "i", "j"), ngram_join._pieces(hot, "cid", "j", "i")
    met = left.join(right, ["token", "i", "j"])
    assert met.count() == met.select("x", "cid").distinct().count() == 2000**2
    assert left.groupBy("i", "j").count().agg({"count": "max"}).first()[0] < 2000 / ngram_join.HOT_PIECES * 1.5


def test_the_sketch_grows_with_the_text_within_bounds(spark, monkeypatch):
    docs = spark.createDataFrame([(1, "x" * 1000), (2, None)], "doc_id long, text string")
    assert ngram_join.sketch_size(docs) == 1 << 22 and ngram_join.sketch_size(docs.limit(0)) == 1 << 22
    monkeypatch.setattr(ngram_join, "SKETCH_BITS", 3)
    monkeypatch.setattr(ngram_join, "COUNTER_CHARS", 10)
    assert ngram_join.sketch_size(docs) == 128
    monkeypatch.setattr(ngram_join, "MOST_SKETCH_BITS", 5)
    assert ngram_join.sketch_size(docs) == 32
