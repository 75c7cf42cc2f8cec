"""Every parsed line gets exactly one treatment; confirmed duplicates point at the first line of their run."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import blocks

TREATMENTS = ("included_spending", "excluded_duplicate", "uncategorized_outflow", "uncategorized_credit", "unparsed")


def adjacent_duplicates(rows: DataFrame, group: str, order: str, same: list[str], confirmed: Column | None = None, usable: Column | None = None, step: bool = True, width: int | None = None) -> DataFrame:
    """Adds is_duplicate and duplicate_of: the row before it agrees on ``same``; runs point at their first row.

    ``step``: the row before must have the number just before. ``usable``: rows that may be an origin. A group of any
    length is gone through in blocks (of ``width`` numbers).
    """
    true = F.lit(True)
    marked = rows.withColumns({"_usable": F.coalesce(true if usable is None else usable, F.lit(False)), "_vouched": F.coalesce(true if confirmed is None else confirmed, F.lit(False))})

    def follows(before: Column, here: Column) -> Column:
        agree = before["_usable"] & here["_vouched"]
        for c in same:
            agree &= before[c].eqNullSafe(here[c])
        return agree & (here[order] == before[order] + 1) if step else agree

    found = blocks.chains(marked, [group], order, follows, [*same, "_usable", "_vouched"], "_origin", width)
    found = found.withColumn("duplicate_of", F.when(F.col("follows"), F.col("_origin")))
    return found.withColumnRenamed("follows", "is_duplicate").drop("_usable", "_vouched", "_origin").select(*rows.columns, "is_duplicate", "duplicate_of")


def treatment(is_duplicate: Column, complete: Column, category: Column, amount: Column) -> Column:
    missing = F.raise_error(F.lit("a complete line has no category")).cast("string")
    return (
        F.when(~complete, "unparsed")
        .when(is_duplicate, "excluded_duplicate")
        .when(category.isNull(), missing)
        .when(category != "uncategorized", "included_spending")
        .when(amount < 0, "uncategorized_credit")
        .otherwise("uncategorized_outflow")
    )


def reconcile(categorised: DataFrame, confirmed: DataFrame) -> DataFrame:
    """Lines with treatment and duplicate_of. confirmed: log_id, line_number of duplicates that the caller vouches for."""
    complete = F.col("occurred_on").isNotNull() & F.col("amount").isNotNull() & F.col("description").isNotNull()
    rows = categorised.join(confirmed.select("log_id", "line_number").distinct().withColumn("_confirmed", F.lit(True)), ["log_id", "line_number"], "left")
    rows = rows.withColumn("_complete", complete)
    rows = adjacent_duplicates(rows, "log_id", "line_number", ["source_text", "occurred_on", "description", "amount"], F.col("_confirmed") & F.col("_complete"), F.col("_complete"))
    rows = rows.withColumn("treatment", treatment(F.col("is_duplicate"), F.col("_complete"), F.col("category"), F.col("amount")))
    return rows.drop("_confirmed", "_complete", "is_duplicate")


def unmatched_confirmations(transactions: DataFrame, confirmed: DataFrame) -> DataFrame:
    """Confirmed lines that are no duplicates: must be none."""
    found = transactions.filter(F.col("treatment") == "excluded_duplicate")
    return confirmed.join(found, ["log_id", "line_number"], "left_anti")


def aligned(lines: DataFrame, categorised: DataFrame) -> DataFrame:
    """Slots that do not carry their line's text, and lines or slots without a partner: must be none."""
    slots = categorised.select("log_id", "line_number", F.col("source_text").alias("slot_text"), F.lit(1).alias("_slot"))
    both = lines.withColumn("_line", F.lit(1)).join(slots, ["log_id", "line_number"], "full")
    return both.filter(F.col("_line").isNull() | F.col("_slot").isNull() | ~F.col("source_text").eqNullSafe(F.col("slot_text"))).select("log_id", "line_number")


def input_problems(lines: DataFrame, confirmed: DataFrame) -> DataFrame:
    """log_id and problem texts: no lines, repeated confirmations, confirmations outside 2..n; all at once."""
    sizes = lines.groupBy("log_id").agg(F.max("line_number").alias("n"), F.count_if(F.col("source_text").isNull()).alias("no_text"))
    empty = sizes.filter("no_text > 0").select("log_id", F.format_string("%d lines are not text", "no_text").alias("problem"))
    repeated = confirmed.groupBy("log_id", "line_number").count().filter("count > 1")
    repeated = repeated.select("log_id", F.format_string("confirmed line %d is repeated", "line_number").alias("problem"))
    outside = confirmed.join(sizes, "log_id", "left").filter(F.col("n").isNull() | (F.col("line_number") < 2) | (F.col("line_number") > F.col("n")))
    outside = outside.select("log_id", F.format_string("confirmed line %d is outside 2..%s", "line_number", F.coalesce(F.col("n").cast("string"), F.lit("0"))).alias("problem"))
    return empty.unionByName(repeated).unionByName(outside)


def validate(problems: DataFrame, what: str) -> None:
    """Raise all problems together (bounded: the first thousand are shown)."""
    found = [str(r.asDict()) for r in problems.limit(1000).collect()]
    if found:
        raise ValueError(f"{what}: " + "; ".join(found))
