import random

import pytest
from pyspark.sql import functions as F

from tallyframe.llm import url_filter as uf


@pytest.mark.parametrize("segment_bits, pass_bytes, n", [(1 << 23, 32 << 20, 900), (1 << 7, 32 << 20, 900), (1 << 6, 1 << 6, 400)])
def test_membership_is_exact(spark, monkeypatch, segment_bits, pass_bytes, n):
    monkeypatch.setattr(uf, "SEGMENT_BITS", segment_bits)
    monkeypatch.setattr(uf, "PASS_BYTES", pass_bytes)
    monkeypatch.setattr(uf, "LATER_PROBES", 2)
    rng = random.Random(4)
    keys = [f"host{k}.example/{rng.random()}" for k in range(n)]
    listed = set(rng.sample(keys, n // 3))
    rows = spark.createDataFrame([(k, keys[k % n] if k % 3 else keys[5]) for k in range(2 * n)], "page_id long, key string")
    extra = [(k,) for k in [*listed, *listed, "nowhere", None]]
    cascade = uf.build(rows, spark.createDataFrame(extra, "key string"))
    assert len(cascade.levels) > 2 and (segment_bits > 1 << 20) == (cascade.segments == 1) and (pass_bytes < 1 << 20) == (len(cascade.batches()) > 1)
    out = cascade.judged(rows)
    got = out.collect()
    assert len(got) == 2 * n and all(r.listed == (r.key in listed) for r in got)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan


def test_one_kind_of_key_only(spark):
    keys = spark.createDataFrame([("a",), ("b",), (None,)], "key string")
    none, every = uf.build(keys, keys.limit(0)), uf.build(keys, keys)
    assert not none.levels and {r.listed for r in none.judged(keys).collect()} == {False}
    assert {r.key: r.listed for r in every.judged(keys.filter("key is not null")).collect()} == {"a": True, "b": True}


def test_rules_and_parts(spark):
    urls = [
        ("https://A.Example.NET/en/x?q#f", "a.example.net", "/en/x", "example.net/en/", "allow"),
        ("http://b.net/EN/", "b.net", "/EN/", "net/", "block"),
        ("http://net", "net", "", None, "allow"),
        ("http://xnet/", "xnet", "/", None, "allow"),
        ("http://example.com/de/1", "example.com", "/de/1", "example.com/de/", "block"),
        ("http://notexample.com/de/1", "notexample.com", "/de/1", None, "allow"),
        ("ftp://x.org?/fr/", "x.org", "", None, "allow"),
        ("http://x.org/fr/#", "x.org", "/fr/", "org/fr/", "allow"),
        ("a://b://c/d", "b:", "//c/d", None, "allow"),
        ("http://my-casino.example.org/x", "my-casino.example.org", "/x", None, "block"),
        ("http://mycasino.example.org/x", "mycasino.example.org", "/x", None, "allow"),
        ("http://ads.net/x", "ads.net", "/x", "net/", "block"),
        ("no scheme", "", "", None, "allow"),
        ("", "", "", None, "allow"),
        (None, "", "", None, "allow"),
        ("http://long.org/" + "p" * 50_000, "long.org", "/" + "p" * 50_000, None, "allow"),
        ("http://ÄÖ.ORG/fr/ü", "ÄÖ.org", "/fr/ü", "org/fr/", "allow"),
    ]
    rows = [(k, u[0], "x", "y", "z") for k, u in enumerate(urls)] + [(None, None, "", "", ""), (3, urls[3][0], "", "", "")]
    pages = spark.createDataFrame(rows, "page_id long, url string, host string, key string, listed string")
    got = sorted(map(tuple, uf.judge(pages, uf.listed_by_terms(pages)).collect()), key=repr)
    want = [(k, *u[1:]) for k, u in enumerate(urls)] + [(None, *urls[-3][1:]), (3, *urls[3][1:])]
    assert got == sorted(want, key=repr)


def test_longest_rule_wins_and_no_rules(spark):
    pages = spark.createDataFrame([(1, "http://a.b.c/x/y")], "page_id long, url string")
    rules = [("block", "c", "/"), ("allow", "b.c", "/x"), ("block", "b.c", "/x/"), ("allow", "a.b.c", "/z")]
    row = uf.judge(pages, pages.select(F.lit("q").alias("key")), rules).first()
    assert (row.rule, row.verdict) == ("b.c/x/", "block")
    row = uf.judge(pages, pages.select(F.lit("a.b.c/x/y").alias("key")), []).first()
    assert (row.rule, row.verdict) == (None, "block")


def test_empty_table(spark):
    pages = spark.createDataFrame([], "page_id long, url string")
    assert uf.judge(pages, uf.listed_by_terms(pages)).collect() == []
