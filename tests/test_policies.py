import random
from decimal import Decimal as D
from itertools import chain, combinations

import pytest
from pyspark.sql import functions as F

from tallyframe.operators import grading, policies

REF = "line_number long, amount decimal(18,2), category string, period string, is_counted boolean, policy_name string, alternatives array<string>"
RUN = "line_number long, amount decimal(18,2)"


def made(seed, n_policies, n=80):
    rng = random.Random(seed)
    rows = []
    for k in range(n):
        p = rng.choice([None, *range(n_policies)]) if n_policies else None
        alternatives = rng.choice([["a"], ["b"], ["c", "a"], ["c"], None]) if p is not None else None
        rows.append((k, D(rng.randint(1, 3)), rng.choice("aab"), rng.choice(["x", "x", "y"]), rng.random() < 0.9, None if p is None else f"p{p}", alternatives))
    run = [(k, None if rng.random() < 0.1 else D(rng.randint(1, 3))) for k in range(n + 5) if rng.random() < 0.5]
    return rows, run


def brute(rows, run):
    """Each subset's ordinal, names, number of differences and effect."""
    mine = [r for r in rows if r[3] == "x" and r[4]]
    first = {}
    for k, _, c, _, _, p, alt in mine:
        if p and (c == "a" or "a" in (alt or [])):
            first[p] = min(first.get(p, k), k)
    names = sorted(first, key=first.get)
    subsets = sorted(chain.from_iterable(combinations(range(len(names)), k) for k in range(len(names) + 1)), key=lambda s: (len(s), [i not in s for i in range(len(names))]))
    read = dict(run)
    out = []
    for ordinal, subset in enumerate(subsets):
        applied = {names[i] for i in subset}
        here = {}
        for k, amount, c, _, _, p, alt in mine:
            moved = "a" if "a" in (alt or []) else (alt[0] if alt else c)
            if (moved if p in applied else c) == "a":
                here[k] = amount
        gaps = [-here[k] for k in here if k not in read] + [read[k] or D(0) for k in read if k not in here] + [(read[k] or D(0)) - here[k] for k in here if k in read and read[k] != here[k]]
        out.append((ordinal, [names[i] for i in subset], len(gaps), sum(gaps, D(0))))
    return out


@pytest.mark.parametrize("seed, n_policies", [(1, 3), (2, 5), (3, 1), (4, 0)])
def test_equals_trying_every_subset(spark, seed, n_policies):
    rows, run = made(seed, n_policies)
    reference, read = spark.createDataFrame(rows, REF).repartition(3), spark.createDataFrame(run, RUN)
    gaps = policies.separable_differences(reference, read, read, "a", "x")
    accepted = policies.touching(reference, "a", "x")
    every = brute(rows, run)
    ordinal, applied, n, effect = min(every, key=lambda r: (r[2], r[0]))
    best = policies.best_subset(policies.scores(gaps, accepted))
    got = best.first()
    assert (got.ordinal, got.applied, got.n, got.effect) == (ordinal, applied, n, effect)
    assert policies.differences_under(gaps, best).count() == n
    if n_policies:
        subsets = grading.policy_subsets(accepted).select(F.col("ordinal").cast("int").alias("ordinal"), "applied")
        listed = {r.ordinal: (r.n, r.e) for r in policies.differences_by_subset(gaps, subsets).groupBy("ordinal").agg(F.count("*").alias("n"), F.sum("effect").alias("e")).collect()}
        assert listed == {o: (m, e) for o, _, m, e in every if m}
        with pytest.raises(Exception, match="subsets to list"):
            policies.differences_by_subset(gaps, subsets, 1).collect()


def test_ordinals_of_many_policies(spark):
    rows = spark.createDataFrame([([], 40), ([0], 40), ([39], 40), ([0, 1], 40), ([38, 39], 40), (list(range(40)), 40), ([], 0)], "places array<int>, n int")
    got = [r[0] for r in rows.select(policies._ordinal(F.col("places"), F.col("n"))).collect()]
    assert got == [0, 1, 40, 41, 40 + 780, 2**40 - 1, 0]
