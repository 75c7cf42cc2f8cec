"""Sets of line numbers as runs: consecutive numbers are one (first, last), and runs lie in pages of bounded size.

Behind each figure stand the lines that it was added from. A list of them grows with the group; runs of a group whose lines
follow each other do not, and where they do not follow, a page holds the runs that begin in one block of numbers, so no row
grows with a log. Sets merge by union of their runs. Null numbers are left out, repeated ones count once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import blocks

LINE = "line_number"


def runs(rows: DataFrame, keys: list[str], width: int | None = None) -> DataFrame:
    """keys, first and last of each run of consecutive line numbers."""
    numbers = rows.filter(F.col(LINE).isNotNull()).select(*keys, F.col(LINE).cast("long").alias(LINE)).distinct()
    chained = blocks.chains(numbers, keys, LINE, lambda before, here: here[LINE] == before[LINE] + 1, [], "first", width)
    return chained.groupBy(*keys, "first").agg(F.max(LINE).alias("last"))


def pages(found: DataFrame, keys: list[str], width: int | None = None) -> DataFrame:
    """keys, page, and the runs that begin in its block of numbers, in order."""
    page = F.expr(f"first div {width or blocks.WIDTH}")
    return found.groupBy(*keys, page.alias("page")).agg(F.array_sort(F.collect_list(F.struct("first", "last"))).alias("runs"))


def merged(left: DataFrame, right: DataFrame, keys: list[str], width: int | None = None) -> DataFrame:
    """Runs of the union of two tables of runs: overlapping and adjoining ones become one."""
    both = left.select(*keys, "first", "last").unionByName(right.select(*keys, "first", "last"))
    # at each number the greatest end of the runs that begin there; a run goes on if it begins by the greatest end so far + 1
    both = both.groupBy(*keys, "first").agg(F.max("last").alias("last"))
    reach = blocks.greatest_before(both, keys, "first", F.col("last"), "reach", width)
    begins = reach.withColumn("begin", F.when(F.col("reach").isNull() | (F.col("first") > F.col("reach") + 1), F.col("first")))
    origin = blocks.last_before(begins, keys, "first", F.col("begin"), "origin", width)
    return origin.groupBy(*keys, F.coalesce("begin", "origin").alias("first")).agg(F.max("last").alias("last"))


def count(found: DataFrame, keys: list[str]) -> DataFrame:
    """keys and number of lines."""
    return found.groupBy(*keys).agg(F.sum(F.col("last") - F.col("first") + 1).alias("n"))


def text(runs_column: Column) -> Column:
    """``3-7,9`` for the runs (3, 7) and (9, 9)."""
    one = lambda r: F.when(r["first"] == r["last"], r["first"].cast("string")).otherwise(F.concat(r["first"].cast("string"), F.lit("-"), r["last"].cast("string")))
    return F.array_join(F.transform(runs_column, one), ",")


def listed(found: DataFrame, keys: list[str], name: str = "lines") -> DataFrame:
    """keys and the ascending list of all lines: for groups that a reader wants written out."""
    held = F.array_sort(F.collect_list(F.struct("first", "last")))
    return found.groupBy(*keys).agg(F.flatten(F.transform(held, lambda r: F.sequence(r["first"], r["last"]))).alias(name))
