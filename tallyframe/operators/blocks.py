"""Scans along one long group, cut into blocks of its order column.

A window over a whole log is one task, however long the log is. Here a block of WIDTH numbers is summed up by itself, the
summaries of a group (one row a block) are run through in order, and a second pass gives each block what came before it.
Orders are whole numbers and unique in their group; a block has WIDTH rows at most. Rows without a group are a group,
rows without a number come first in theirs. The input is read twice where rows are filled in, so it should be a table or a
cheap plan.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Numbers of a block.
WIDTH = 4096


def numbered(rows: DataFrame, order: str, width: int | None = None) -> DataFrame:
    """``rows`` with their block, ``_block``."""
    return rows.withColumn("_block", F.coalesce(F.expr(f"`{order}` div {width or WIDTH}"), F.lit(-(2**62))))


def inside(group: list[str], order: str):
    return Window.partitionBy(*group, "_block").orderBy(order)


def along(group: list[str]):
    """Blocks of a group in order."""
    return Window.partitionBy(*group).orderBy("_block")


def met(rows: DataFrame, summary: DataFrame, group: list[str]) -> DataFrame:
    """``rows`` with what their block got; both have ``group`` and ``_block``."""
    keys = [*group, "_block"]
    other = summary.select(*(F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)), *[c for c in summary.columns if c not in keys])
    same = F.lit(True)
    for i, k in enumerate(keys):
        same &= F.col(k).eqNullSafe(F.col(f"_k{i}"))
    return rows.join(other, same).drop(*(f"_k{i}" for i in range(len(keys))))


def last_before(rows: DataFrame, group: list[str], order: str, value: Column, name: str, width: int | None = None) -> DataFrame:
    """``rows`` with the last value that is not null before each, in the order of its group."""
    rows = numbered(rows.withColumn("_value", value), order, width)
    ends = rows.groupBy(*group, "_block").agg(F.max_by("_value", F.when(F.col("_value").isNotNull(), F.col(order))).alias("_end"))
    before = F.last("_end", ignorenulls=True).over(along(group).rowsBetween(Window.unboundedPreceding, -1))
    carried = ends.select(*group, "_block", before.alias("_carried"))
    own = F.last("_value", ignorenulls=True).over(inside(group, order).rowsBetween(Window.unboundedPreceding, -1))
    return met(rows, carried, group).withColumn(name, F.coalesce(own, "_carried")).drop("_value", "_carried", "_block")


def row_numbers(rows: DataFrame, group: list[str], order: str, name: str, width: int | None = None) -> DataFrame:
    """``rows`` with their place (from 1) in the order of their group."""
    rows = numbered(rows, order, width)
    sizes = rows.groupBy(*group, "_block").agg(F.count("*").alias("_n"))
    before = F.sum("_n").over(along(group).rowsBetween(Window.unboundedPreceding, -1))
    carried = sizes.select(*group, "_block", F.coalesce(before, F.lit(0)).alias("_carried"))
    place = F.row_number().over(inside(group, order)) + F.col("_carried")
    return met(rows, carried, group).withColumn(name, place).drop("_carried", "_block")


def greatest_before(rows: DataFrame, group: list[str], order: str, value: Column, name: str, width: int | None = None) -> DataFrame:
    """``rows`` with the greatest value before each, in the order of its group."""
    rows = numbered(rows.withColumn("_value", value), order, width)
    ends = rows.groupBy(*group, "_block").agg(F.max("_value").alias("_end"))
    carried = ends.select(*group, "_block", F.max("_end").over(along(group).rowsBetween(Window.unboundedPreceding, -1)).alias("_carried"))
    own = F.max("_value").over(inside(group, order).rowsBetween(Window.unboundedPreceding, -1))
    return met(rows, carried, group).withColumn(name, F.greatest(own, "_carried")).drop("_value", "_carried", "_block")


def chains(rows: DataFrame, group: list[str], order: str, follows, fields: list[str], name: str = "origin", width: int | None = None) -> DataFrame:
    """``rows`` with ``follows`` and the order of the row that their chain began with.

    ``follows(before, here)`` says from the ``fields`` (and the order) of a row and the one before it whether it goes on the
    chain; the first row of a group begins one.
    """
    rows = numbered(rows, order, width)
    w = inside(group, order)
    fields = list(dict.fromkeys([*fields, order]))
    here = F.struct(*fields)
    goes_on = lambda before, now: F.coalesce(before.isNotNull() & follows(before, now), F.lit(False))
    known = rows.select(*group, "_block", *[f for f in fields if f not in group], here.alias("_here"), F.lag(here).over(w).alias("_before"))
    begins = F.when(F.col("_before").isNotNull() & ~goes_on(F.col("_before"), F.col("_here")), F.col(order))
    edges = known.groupBy(*group, "_block").agg(F.min_by("_here", order).alias("_head"), F.max_by("_here", order).alias("_tail"), F.max(begins).alias("_open"))
    edges = edges.withColumn("_on", goes_on(F.lag("_tail").over(along(group)), F.col("_head")))
    edges = edges.withColumn("_open", F.coalesce("_open", F.when(~F.col("_on"), F.col("_head")[order])))
    before = F.last("_open", ignorenulls=True).over(along(group).rowsBetween(Window.unboundedPreceding, -1))
    edges = edges.select(*group, "_block", "_on", before.alias("_carried"))
    both = met(rows, edges, group).withColumn("_before", F.lag(here).over(w))
    both = both.withColumn("follows", F.when(F.col("_before").isNull(), F.col("_on")).otherwise(goes_on(F.col("_before"), here)))
    own = F.last(F.when(~F.col("follows"), F.col(order)), ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))
    return both.withColumn(name, F.coalesce(own, "_carried")).drop("_before", "_on", "_carried", "_block")
