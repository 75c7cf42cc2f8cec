import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from tallyframe.operators import blocks, parsing, reconcile


def log(seed, n=300, logs=3):
    rng = random.Random(seed)
    rows = []
    for g in [*range(logs - 1), None]:
        for k in sorted(rng.sample(range(-20, n), n // 2)):
            rows.append((g, k, rng.choice("aab") if rng.random() < 0.9 else None, rng.random() < 0.8, rng.random() < 0.8, rng.choice([None, None, 1, 2, 8, 12]), rng.choice([None, None, 2024, 2024])))
    return rows


SCHEMA = "g int, k long, v string, c boolean, u boolean, month int, year int"


@pytest.mark.parametrize("width", [4, 16, 4096])
def test_last_before_equals_a_window(spark, width):
    df = spark.createDataFrame(log(1), SCHEMA).repartition(5)
    value = F.when(F.col("c"), F.struct("k", "v"))
    got = blocks.last_before(df, ["g"], "k", value, "l", width)
    want = df.withColumn("l", F.last(value, ignorenulls=True).over(Window.partitionBy("g").orderBy("k").rowsBetween(Window.unboundedPreceding, -1)))
    assert sorted(got.collect(), key=repr) == sorted(want.collect(), key=repr)


@pytest.mark.parametrize("width, step, seed", [(4, True, 2), (4, False, 3), (16, False, 4), (4096, True, 5)])
def test_chains_equal_going_through_the_rows(spark, width, step, seed):
    rows = log(seed)
    df = spark.createDataFrame(rows, SCHEMA).repartition(5)
    got = reconcile.adjacent_duplicates(df, "g", "k", ["v"], F.col("c"), F.col("u"), step, width)
    want, before, origin = {}, None, None
    for r in rows:
        g, k, v, c, u = r[:5]
        dup = before is not None and before[0] == g and before[2] == v and before[4] and c and (not step or k == before[1] + 1)
        origin = origin if dup else k
        want[g, k] = (dup, origin if dup else None)
        before = r
    found = got.collect()
    assert len(found) == len(rows) and {(r.g, r.k): (r.is_duplicate, r.duplicate_of) for r in found} == want
    assert any(d for d, _ in want.values())


@pytest.mark.parametrize("width", [3, 50, 4096])
@pytest.mark.parametrize("seed", range(3))
def test_years_equal_going_through_the_rows(spark, width, seed):
    rng = random.Random(seed)
    rows = [(g, k, None if rng.random() < 0.5 else rng.choice([1, 2, 3] if g % 2 else [1, 8, 12]), rng.choice([None, 2024]) if g % 3 else rng.choice([2023, 2024])) for g in range(12) for k in range(40)]
    rows += [(99, k, None, None) for k in range(5)]
    df = spark.createDataFrame([(str(g), k, m, y if m else None) for g, k, m, y in rows], "log_id string, line_number long, month int, year int")
    want = {}
    for g in sorted({r[0] for r in rows}):
        dated = [(m, y) for h, _, m, y in rows if h == g and m]
        years = {y for _, y in dated if y}
        crossed = any(abs(a[0] - b[0]) >= 6 and not (a[1] and a[1] == b[1]) for a, b in zip(dated, dated[1:]))
        if dated:
            want[str(g)] = years.pop() if len(years) == 1 and not crossed else None
    assert {r.log_id: r.inferred_year for r in parsing.infer_years(df, width).collect()} == want


def test_one_long_log_is_many_tasks(spark):
    n = 60_000
    df = spark.range(n).select(F.lit("one").alias("log_id"), F.col("id").alias("line_number"), (F.col("id") % 50 == 0).alias("c"))
    seen = reconcile.adjacent_duplicates(df, "log_id", "line_number", [], F.col("c")).withColumn("p", F.spark_partition_id())
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        sizes = [r["count"] for r in seen.groupBy("p").count().collect()]
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert sum(sizes) == n and max(sizes) < n / 2
