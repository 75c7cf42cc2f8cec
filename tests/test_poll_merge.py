import random
import time

import pytest
from pyspark.sql import functions as F

from tallyframe.operators import rollout

SCHEMA = "trial_id string, position int, asked string, named array<string>"


def brute(rows):
    out, key, began, known = {}, None, None, set()
    for trial, position, asked, named in sorted(rows, key=lambda r: (r[0] or "", r[1])):
        if trial != key or asked is None or asked not in known:
            began, known = position, set()
        key, known = trial, known | set(named)
        out[trial, position] = began
    return out


@pytest.mark.parametrize("width", [2, 5, 4096])
@pytest.mark.parametrize("seed", range(3))
def test_starts_equal_a_fold(spark, width, seed):
    rng = random.Random(seed)
    rows = []
    for trial in ("a", "b", None):
        for p in sorted(rng.sample(range(400), 150)):
            rows.append((trial, p, None if rng.random() < 0.1 else rng.choice("xyz"), [s for s in "xyzx" if rng.random() < 0.3]))
    got = rollout.event_starts(spark.createDataFrame(rows, SCHEMA).repartition(5), width).collect()
    want = brute(rows)
    assert len(got) == len(rows) and {(r.trial_id, r.position): r.began for r in got} == want
    assert len(set(want.values())) < len(want)


def test_a_long_trial_takes_linear_time(spark):
    seconds = []
    for n in (2_000, 100_000):
        k = F.col("id")
        rows = spark.range(n).select(F.lit("t").alias("trial_id"), k.alias("position"), F.when(k % 1000 != 0, "7").alias("asked"), F.array(F.when(k % 3 == 0, "8").otherwise("7")).alias("named"))
        began = time.time()
        got = rollout.event_starts(rows).groupBy().agg(F.countDistinct("began"), F.count("*")).first()
        seconds.append(time.time() - began)
        # rows that name 8 alone part no event, since an earlier row of the event names 7
        assert got[1] == n and got[0] < n
    assert seconds[1] < 25 * seconds[0]


def test_empty(spark):
    rows = spark.createDataFrame([], "trial_id string, position long, id string, kind string, text string, result string")
    assert rollout.merge_polls(rows).collect() == []
