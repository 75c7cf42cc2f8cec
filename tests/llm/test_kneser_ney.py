import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash

from tallyframe.llm import kneser_ney
from tallyframe.llm.kneser_ney import END, START, discounts_of, held_out, score, train


def tokens(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return re.findall("[^\x20\x09-\x0d]+", low) + ["</s>"]


class Plain:
    """The same model with dictionaries."""

    def __init__(self, texts):
        self.pairs, self.words = Counter(), Counter()
        for t in texts:
            toks = tokens(t)
            self.words.update(toks)
            self.pairs.update(zip(["<s>", *toks], toks))
        self.before, self.after, self.total = Counter(), defaultdict(Counter), Counter()
        for (u, w), c in self.pairs.items():
            self.before[w] += 1
            self.after[u][min(c, 3)] += 1
            self.total[u] += c
        often = lambda counter: [sum(c == k for c in counter.values()) for k in (1, 2, 3, 4)]
        self.d, self.l = [0, *discounts_of(often(self.pairs))], [0, *discounts_of(often(self.before))]
        self.n = sum(self.before.values())
        self.spare = sum(self.l[min(c, 3)] for c in self.before.values()) / self.n

    def p(self, u, w):
        c = self.before[w]
        low = (c - self.l[min(c, 3)]) / self.n + self.spare / (len(self.words) + 1)
        if not self.total[u]:
            return low
        c = self.pairs[(u, w)]
        return (c - self.d[min(c, 3)]) / self.total[u] + sum(self.d[k] * self.after[u][k] for k in (1, 2, 3)) / self.total[u] * low


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(8)
    words = [f"w{k}" for k in range(120)] + ["É", "The"]
    weights = [1 / (k + 1) for k in range(len(words))]
    return [(k, "\t ".join(rng.choices(words, weights, k=rng.choice([0, 5, 60, 900])))) for k in range(150)] + [(900, None), (901, "x" * 50_000), (902, "THE the")]


def test_scores_equal_the_plain_model(spark, rows, monkeypatch):
    monkeypatch.setattr(kneser_ney, "BUFFER", 3000)
    docs = spark.createDataFrame([(*r, 1.0) for r in rows], "doc_id long, text string, score double").repartition(4)
    out = lambda k: zlib.crc32(str(k).encode()) % 10 == 0
    plain = Plain([t for k, t in rows if not out(k)])
    n, v = sum(plain.words.values()), len(plain.words)
    for r in score(docs, train(docs.filter(~held_out()))).collect():
        toks = tokens(dict(rows)[r.doc_id])
        assert r.held_out == out(r.doc_id) and r.n_tokens == len(toks) and r.train_tokens == n
        assert r.n_known == sum(plain.words[t] > 0 for t in toks)
        assert math.isclose(r.base_score, sum(math.log10((plain.words[t] + 0.1) / (n + 0.1 * (v + 1))) for t in toks), rel_tol=1e-9)
        assert math.isclose(r.score, sum(math.log10(plain.p(u, w)) for u, w in zip(["<s>", *toks], toks)), rel_tol=1e-9)


def test_probabilities_sum_to_one(spark, rows):
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    model = train(docs)
    hashes = np.array([xxhash.xxh3_64_intdigest(w) for w in Plain([t for _, t in rows]).words if w != "</s>"] + [int(END), 12345], np.uint64)
    for context in (START, hashes[0], np.uint64(99)):
        logs, _ = model.log10(np.full(len(hashes), context), hashes)
        assert math.isclose((10**logs).sum(), 1, rel_tol=1e-9)


def test_without_training_rows(spark):
    docs = spark.createDataFrame([(1, "a b"), (None, None), (1, "a b")], "doc_id long, text string")
    got = score(docs, train(docs.limit(0))).collect()
    assert [r.score for r in got] == [0, 0, 0] and [r.base_score for r in got] == [0, 0, 0] and [r.held_out for r in got] == [False, True, False]
    assert score(docs.limit(0), train(docs)).count() == 0


class PlainOrder:
    """The model of any order with dictionaries; the start mark alone is before the first word."""

    def __init__(self, texts, order):
        self.order, self.words = order, Counter()
        raw = [Counter() for _ in range(order + 1)]
        for t in texts:
            toks = tokens(t)
            self.words.update(toks)
            toks = ["<s>", *toks]
            for n in range(1, order + 1):
                raw[n].update(tuple(toks[i - n + 1 : i + 1]) for i in range(max(1, n - 1), len(toks)))
        self.c = [Counter() for _ in range(order)] + [raw[order]]
        for n in range(1, order):
            for g in raw[n + 1]:
                self.c[n][g[1:]] += 1
            if n > 1:
                self.c[n].update({g: c for g, c in raw[n].items() if g[0] == "<s>"})
        self.d = [[0, *discounts_of([sum(c == k for c in level.values()) for k in (1, 2, 3, 4)])] for level in self.c]
        self.total, self.after = Counter(), defaultdict(Counter)
        for level in self.c[1:]:
            for g, c in level.items():
                self.total[g[:-1]] += c
                self.after[g[:-1]][min(c, 3)] += 1

    def p(self, context, w):
        n = len(context) + 1
        low = self.p(context[1:], w) if context else 1 / (len(self.words) + 1)
        total = self.total[context]
        if not total:
            return low
        c = self.c[n][(*context, w)]
        return (c - self.d[n][min(c, 3)]) / total + sum(self.d[n][k] * self.after[context][k] for k in (1, 2, 3)) / total * low


@pytest.mark.parametrize(("order", "shard_tokens", "fan"), [(2, 3_000_000, 2048), (3, 3_000_000, 2048), (4, 3_000_000, 2048), (2, 900, 3), (3, 900, 3), (4, 2_500, 2)])
def test_higher_orders_equal_the_plain_model(spark, rows, monkeypatch, order, shard_tokens, fan):
    monkeypatch.setattr(kneser_ney, "BUFFER", 3000)
    monkeypatch.setattr(kneser_ney, "SHARD_TOKENS", shard_tokens)
    monkeypatch.setattr(kneser_ney, "WORD_FILE_CHARS", 100_000)
    monkeypatch.setattr(kneser_ney, "FAN", fan)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    out = lambda k: zlib.crc32(str(k).encode()) % 10 == 0
    plain = PlainOrder([t for k, t in rows if not out(k)], order)
    model = train(docs.filter(~held_out()), order)
    assert (model.last_hot > 0) == (shard_tokens < 3000) and (model.cold > 3) == (shard_tokens < 3000)
    for r in score(docs, model).collect():
        toks = ["<s>", *tokens(dict(rows)[r.doc_id])]
        assert r.n_known == sum(plain.words[t] > 0 for t in toks[1:])
        want = sum(math.log10(plain.p(tuple(toks[max(0, i - order + 1) : i]), toks[i])) for i in range(1, len(toks)))
        assert math.isclose(r.score, want, rel_tol=1e-9)
    hashes = np.array([xxhash.xxh3_64_intdigest(w) for w in plain.words if w != "</s>"] + [int(END), 12345], np.uint64)
    for context in ([START] * (order - 1), [*hashes[: order - 1]], [*[START] * (order - 2), hashes[0]]):
        logs, _ = model.log10(np.repeat(np.array(context, np.uint64)[:, None], len(hashes), axis=1), hashes)
        assert math.isclose((10**logs).sum(), 1, rel_tol=1e-9)


def test_the_query_uses_two_words_of_context(spark, tmp_path):
    texts = [f"x{k % 2} mid y{k % 2}" for k in range(60)]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = kneser_ney.op2_kneser_ney(spark, str(tmp_path)).agg({"perplexity": "max"}).first()[0]
    two = score(docs := spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), train(docs.filter(~held_out()))).agg({"perplexity": "min"}).first()[0]
    assert got < two


def test_rows_are_packed_without_loss():
    rng = np.random.default_rng(3)
    for width, contexts in [(1, False), (2, False), (3, False), (4, False), (1, True), (2, True), (3, True)]:
        for top in (3, 300, 2**34):
            columns = rng.integers(0, top, (width, 2000)).astype(np.uint64)
            shard = rng.integers(0, 9, 2000)
            rows = kneser_ney._dealt(2 * width + contexts, columns, [np.ones(2000, np.int64), columns[0].astype(np.int64)], shard, 9)
            want, got = Counter(), Counter()
            for k, *gram in zip(shard.tolist(), *columns.tolist()):
                want[(k, *gram)] += 1
            for k, _, data in rows:
                found, (n, first) = kneser_ney._decoded(data, contexts)
                assert (first == n * found[0].astype(np.int64)).all()
                for m, *gram in zip(n.tolist(), *found.tolist()):
                    got[(k, *gram)] += m
            assert got == want


def test_tables_find_what_they_hold(tmp_path):
    rng = np.random.default_rng(4)
    for n in (0, 1, 7, 5000):
        key = np.unique(rng.integers(0, 2**64, n, dtype=np.uint64))
        if n == 5000:  # the second agrees with the first in all but the last bits
            key = np.unique(np.append(key, key[:1] + np.uint64(1)))
        values = [rng.integers(1, 900, len(key)), rng.integers(0, 3, len(key))]
        kneser_ney._save_table(str(tmp_path), f"t{n}", key, values)
        table = kneser_ney._mapped(f"{tmp_path}/t{n}.arrays")
        assert (kneser_ney._places(table, key) == np.arange(len(key))).all()
        assert (table["values"][table["codes"]] == np.stack(values, axis=1)).all() or not len(key)
        assert (kneser_ney._places(table, rng.integers(0, 2**64, 50, dtype=np.uint64)) == -1).all()
