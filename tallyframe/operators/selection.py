"""Exact medians of groups of any size by counting and narrowing down; no task holds a group.

A rank is looked for between two values that it must lie between, at first none. A round takes about a hundred of the
values in between (approximate percentiles, so they part them evenly), counts what lies below and at each, and either hits
the rank or keeps the gap that holds it. Where a gap holds few values they are sorted. Every round is two passes of partial
counts over the values that are still in question.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.shared import fresh

#: Values of a group that are sorted at once.
FEW = 10_000
#: Ranks in question that are sent to every task; beyond, rows are joined with them in SALTS parts.
SENT = 10_000
SALTS = 32
_GRID = [k / 100 for k in range(101)]


def _staged(df: DataFrame) -> DataFrame:
    path = fresh(df.sparkSession, "ranks")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _within(rows: DataFrame, ranks: DataFrame, group: list[str], n: int) -> DataFrame:
    """Rows that lie in the gap of a rank of their group, with that rank."""
    other = ranks.select(*(F.col(g).alias(f"_g{i}") for i, g in enumerate(group)), "k", "low", "high", "below")
    same = reduce(lambda a, b: a & b, (F.col(g).eqNullSafe(F.col(f"_g{i}")) for i, g in enumerate(group)), F.lit(True))
    if n <= SENT:
        met = rows.join(F.broadcast(other), same)
    else:
        rows = rows.withColumn("_salt", F.pmod(F.monotonically_increasing_id(), F.lit(SALTS)))
        other = other.withColumn("_s", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))))
        met = rows.join(other, same & (F.col("_salt") == F.col("_s")))
    open_ = (F.col("low").isNull() | (F.col("v") > F.col("low"))) & (F.col("high").isNull() | (F.col("v") < F.col("high")))
    return met.filter(open_).select(*group, "k", "low", "high", "below", "v")


def _round(rows: DataFrame, ranks: DataFrame, group: list[str], n: int) -> DataFrame:
    """group, k and either the value at that rank or the next gap, what lies below it and inside."""
    keys = [*group, "k"]
    near = _within(rows, ranks, group, n)
    pivots = near.groupBy(*keys).agg(F.array_sort(F.array_distinct(F.percentile_approx("v", _GRID, 1000))).alias("pivots"), F.min("low").alias("low"), F.min("high").alias("high"), F.min("below").alias("below"))
    pivots = _staged(pivots)
    near = _within(rows, pivots, group, n)
    other = pivots.select(*(F.col(c).alias(f"_k{i}") for i, c in enumerate(keys)), "pivots")
    same = reduce(lambda a, b: a & b, (F.col(c).eqNullSafe(F.col(f"_k{i}")) for i, c in enumerate(keys)))
    met = near.join(F.broadcast(other) if n <= SENT else other, same)
    lower = F.size(F.filter("pivots", lambda p: p < F.col("v")))
    # code 2j: the pivot j itself; 2j - 1: between the pivots j - 1 and j
    code = F.when(F.array_contains("pivots", F.col("v")), 2 * lower).otherwise(2 * lower - 1)
    counts = met.groupBy(*keys, code.alias("code")).count()
    held = counts.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("code", "count"))).alias("counts"))
    state = F.struct(F.col("below").alias("seen"), F.lit(None).cast("int").alias("code"), F.lit(None).cast("long").alias("inside"))
    found = F.aggregate("counts", state, lambda s, c: F.when(s["code"].isNotNull(), s).when(s["seen"] + c["count"] >= F.col("k"), F.struct(s["seen"].alias("seen"), c["code"].alias("code"), c["count"].alias("inside"))).otherwise(F.struct((s["seen"] + c["count"]).alias("seen"), s["code"].alias("code"), s["inside"].alias("inside"))))
    other = held.select(*(F.col(c).alias(f"_k{i}") for i, c in enumerate(keys)), "counts")
    out = pivots.join(other, same).withColumn("f", found)
    at, code = F.col("pivots"), F.col("f.code")
    hit = code % 2 == 0
    j = F.floor((code + 1) / 2).cast("int")
    return out.select(
        *keys,
        F.when(hit, F.get(at, F.floor(code / 2).cast("int"))).alias("v"),
        F.when(~hit, F.get(at, j - 1)).alias("low"),
        F.when(~hit, F.get(at, j)).alias("high"),
        F.col("f.seen").alias("below"),
        F.col("f.inside").alias("inside"),
    )


def medians(rows: DataFrame, group: list[str], value: Column, few: int = FEW) -> DataFrame:
    """group and median (double) of the values that are not null; groups without any give no row.

    Groups of up to ``few`` values are sorted; where all are, nothing is narrowed down and nothing runs but a count.
    """
    kind = "decimal(38,18)" if "decimal" in dict(rows.select(value.alias("v")).dtypes)["v"] else "double"
    rows = rows.select(*group, value.cast(kind).alias("v")).filter("v is not null")
    sizes = _staged(rows.groupBy(*group).agg(F.count("*").alias("n")))
    if sizes.filter(F.col("n") > few).isEmpty():
        return rows.groupBy(*group).agg(F.median("v").cast("double").alias("median"))
    # the two middle ranks, which are one in groups of odd size
    ks = F.array_distinct(F.array(F.expr("(n + 1) div 2"), F.expr("n div 2 + 1")))
    none = F.lit(None).cast(kind)
    ranks = sizes.select(*group, F.explode(ks).alias("k"), none.alias("v"), none.alias("low"), none.alias("high"), F.lit(0).cast("long").alias("below"), F.col("n").alias("inside"))
    done = []
    while True:
        done.append(ranks.filter((F.col("v").isNotNull()) | (F.col("inside") <= few)))
        ranks = _staged(ranks.filter(F.col("v").isNull() & (F.col("inside") > few)))
        n = ranks.count()
        if not n:
            break
        ranks = _staged(_round(rows, ranks, group, n))
    done = _staged(reduce(DataFrame.unionByName, done))
    hits = done.filter("v is not null").select(*group, "v")
    open_ = done.filter("v is null")
    left = _within(rows, open_, group, open_.count())
    sorted_ = left.groupBy(*group, "k").agg(F.array_sort(F.collect_list("v")).alias("vs"), F.min("below").alias("below"))
    sorted_ = sorted_.select(*group, F.get("vs", (F.col("k") - F.col("below") - 1).cast("int")).alias("v"))
    both = hits.unionByName(sorted_)
    return both.groupBy(*group).agg((F.min("v") / 2 + F.max("v") / 2).cast("double").alias("median"))
