import random

import pytest
from pyspark.sql import functions as F

from tallyframe.operators import line_sets


def brute(numbers):
    out = []
    for n in sorted(numbers):
        if out and n == out[-1][1] + 1:
            out[-1][1] = n
        else:
            out.append([n, n])
    return [tuple(r) for r in out]


@pytest.mark.parametrize("width", [4, 32, 4096])
def test_runs_pages_and_union(spark, width):
    rng = random.Random(width)
    sets = {g: [set(rng.sample(range(150), 60)) for _ in range(2)] for g in ("a", None)}
    sets["b"] = [set(range(40)), set(range(40, 90))]
    parts = []
    for side in range(2):
        rows = [(g, n) for g, s in sets.items() for n in s[side]] * 2 + [("a", None)]
        parts.append(line_sets.runs(spark.createDataFrame(rows, "g string, line_number int").repartition(3), ["g"], width))
    for side, found in enumerate(parts):
        got = {g: sorted((r.first, r["last"]) for r in found.collect() if r.g == g) for g in sets}
        assert got == {g: brute(s[side]) for g, s in sets.items()}
    union = line_sets.merged(*parts, ["g"], width)
    assert {g: sorted((r.first, r["last"]) for r in union.collect() if r.g == g) for g in sets} == {g: brute(s[0] | s[1]) for g, s in sets.items()}
    assert {r.g: r.lines for r in line_sets.listed(parts[0], ["g"]).collect()} == {g: sorted(s[0]) for g, s in sets.items()}
    assert {r.g: r.n for r in line_sets.count(union, ["g"]).collect()} == {g: len(s[0] | s[1]) for g, s in sets.items()}
    assert all(len(r.runs) <= width for r in line_sets.pages(parts[0], ["g"], width).collect())


def test_text(spark):
    row = spark.sql("SELECT array(named_struct('first', 3, 'last', 7), named_struct('first', 9, 'last', 9)) AS r").select(line_sets.text(F.col("r")).alias("t")).first()
    assert row.t == "3-7,9"


def test_a_large_group_is_few_rows(spark):
    rows = spark.range(2_000_000).filter("id <> 777777").select(F.when(F.col("id") >= 0, "g").alias("g"), F.col("id").alias("line_number"))
    got = line_sets.pages(line_sets.runs(rows, ["g"]), ["g"]).orderBy("page").collect()
    assert [tuple(x) for r in got for x in r.runs] == [(0, 777776), (777778, 1999999)]
