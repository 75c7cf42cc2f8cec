import random
import statistics

import pytest
from pyspark.sql import functions as F

from tallyframe.operators import grading, selection


@pytest.mark.parametrize("sent", [10_000, 0])
def test_medians_equal_sorting(spark, monkeypatch, sent):
    monkeypatch.setattr(selection, "SENT", sent)
    monkeypatch.setattr(selection, "SALTS", 3)
    rng = random.Random(1)
    values = {
        "normal": [rng.gauss(0, 1) for _ in range(2001)],
        "even": [rng.random() for _ in range(2000)],
        "wild": [10.0 ** rng.randint(-300, 300) for _ in range(1500)],
        "halves": [0.0] * 700 + [1.0] * 700,
        "ties": [rng.choice([1.0, 2.0, 2.0, 2.0, 3.0]) for _ in range(1001)],
        "one": [5.0],
        "two": [1.0, 4.0],
        None: [float(k) for k in range(999)],
        "empty": [None, None],
    }
    rows = [(g, v) for g, vs in values.items() for v in vs]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "g string, v double").repartition(4)
    got = {r.g: r.median for r in selection.medians(df, ["g"], F.col("v"), few=30).collect()}
    want = {g: statistics.median(vs) for g, vs in values.items() if vs[0] is not None}
    assert got.keys() == want.keys() and all(got[g] == pytest.approx(want[g], rel=1e-12) for g in want)


def test_small_groups_and_texts(spark):
    df = spark.createDataFrame([("a", 1.0, True), ("a", 3.0, True), ("a", 99.0, False), ("b", 1.0, False)], "g string, seconds double, ok boolean")
    summary = grading.timing_summary(df, ["g"], completed=F.col("ok"))
    assert {r.g: tuple(r)[1:] for r in summary.collect()} == {"a": (2.0, 1.0, 3.0, 2), "b": (None, None, None, 0)}
    assert {r.g: r.timing for r in grading.timing_texts(summary, df, ["g"]).collect()} == {"a": "2.0s (1.0s to 3.0s), 2 of 3 runs", "b": "no completed runs of 1"}
