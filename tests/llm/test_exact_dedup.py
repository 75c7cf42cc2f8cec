import hashlib
import random
import re

import numpy as np
from pyspark.sql import functions as F

from tallyframe.llm import exact_dedup
from tallyframe.llm.exact_dedup import _by_text, bloom, deduplicated, groups, may_contain, normalised


def brute(rows):
    norm = [(k, re.sub("[\x20\x09-\x0d]+", " ", t or "")) for k, t in rows]
    sizes, keep = {}, {}
    for k, t in norm:
        sizes[t] = sizes.get(t, 0) + 1
        keep[t] = min(keep.get(t, 10**18), k)
    return {(k, keep[t], sizes[t], k == keep[t], hashlib.sha256(t.encode()).hexdigest()) for k, t in norm}


def test_groups_equal_brute_force(spark, monkeypatch):
    monkeypatch.setattr(exact_dedup, "MEMTABLE_ROWS", 7)
    rng = random.Random(5)
    rows = [(k, rng.choice(["a b", "a  b", "a\tb\n", "", None, "é x", "x" * 20000, f"own {k}", " a b", "a\x0bb", "a b"])) for k in range(200)]
    docs = spark.createDataFrame([(k, t, "q") for k, t in rows], "doc_id long, text string, keep_id string").repartition(5)
    assert {tuple(r) for r in groups(docs).collect()} == brute(rows)
    left = deduplicated(docs).collect()
    assert {r.doc_id for r in left} == {r[0] for r in brute(rows) if r[3]} and left[0].keep_id == "q"
    assert groups(docs.limit(0)).count() == 0 and deduplicated(docs.limit(0)).count() == 0


def test_repeated_rows_and_missing_ids(spark):
    docs = spark.createDataFrame([(1, "a"), (1, "a"), (1, "b"), (None, "a"), (None, "c"), (None, "c")], "doc_id long, text string")
    got = groups(docs).collect()
    assert sum(r.kept for r in got) == 3 and len(got) == 6
    assert {r.keep_id for r in got if r.group_size == 3} == {1}
    assert sorted((r.doc_id or 0, r.text) for r in deduplicated(docs).collect()) == [(0, "c"), (1, "a"), (1, "b")]


def test_extreme_ids_and_clashing_columns(spark):
    top, least = 2**63 - 1, -(2**63)
    rows = [(top, "a", "p", 1), (None, "a", "q", 2), (top, "b", "r", 3), (None, "c", "s", 4), (least, "d", "t", 5), (0, "d", "u", 6), (None, "d", "v", 7)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, _digest string, digest_0 long").withColumn("Keep_0", F.lit(9)).withColumn("_keep_id", F.lit("k"))
    got = {(r.doc_id, r.keep_id, r.group_size, r.kept) for r in groups(docs).collect()}
    assert got == {(top, top, 2, True), (None, top, 2, False), (top, top, 1, True), (None, None, 1, True), (least, least, 3, True), (0, least, 3, False), (None, least, 3, False)}
    left = deduplicated(docs)
    assert left.columns == docs.columns
    assert sorted((r.text, r["_digest"], r.digest_0, r["Keep_0"], r["_keep_id"]) for r in left.collect()) == [(t, d, n, 9, "k") for _, t, d, n in rows if d in "prst"]


def test_texts_that_share_a_digest_are_told_apart(spark):
    docs = spark.createDataFrame([(1, "a"), (2, "b"), (3, "a")], "doc_id long, text string")
    texts = docs.select("doc_id", normalised(F.col("text")).alias("norm"))
    bad = texts.select(F.unhex(F.sha2("norm", 256)).alias("digest")).distinct()
    assert sorted((r.doc_id, r.keep_id, r.group_size) for r in _by_text(texts, bad).collect()) == [(1, 1, 2), (2, 2, 1), (3, 1, 2)]


def test_levels_equal_one_merge():
    rng = np.random.default_rng(3)
    pool = rng.integers(0, 2**63, (300, 4), dtype=np.uint64)
    pool[100:, 0] = pool[rng.integers(0, 100, 200), 0]  # equal first words
    levels, parts = exact_dedup.Levels(), []
    for _ in range(40):
        pick = rng.integers(0, 300, rng.integers(1, 60))
        run = exact_dedup._sorted_run(pool[pick], rng.integers(0, 2, len(pick)).astype(np.uint8), rng.integers(0, 1000, len(pick)), rng.integers(0, 9, len(pick)), np.ones(len(pick), np.int64))
        levels.add(run, bloom(run[0]))
        parts.append(run)
    want = exact_dedup._sorted_run(*map(np.concatenate, zip(*parts)))
    for got, expected in zip(levels.merged(), want):
        assert (got == expected).all()


def test_filter_has_no_misses():
    rng = np.random.default_rng(1)
    words = rng.integers(0, 2**63, (5000, 4), dtype=np.uint64)
    table = bloom(words[:2500])
    assert may_contain(table, words[:2500]).all() and may_contain(table, words[2500:]).mean() < 0.05
