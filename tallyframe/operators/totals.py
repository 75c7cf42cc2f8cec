"""Exact decimal totals with the row numbers behind them, budgets, changes and the balance check.

Transactions are (log_id, line_number, occurred_on, amount, treatment, category, policy_note). The row numbers behind a
figure are runs in pages (``category_lines``, ``month_lines``, ``treatment_lines``, ``coverage_runs``), whatever a group's size.
``lines=True`` also lists them in the row of the figure, for logs that a reader wants written out.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import line_sets
from .policy import MIXED_NOTE
from .reconcile import TREATMENTS

MONEY = "decimal(28,2)"
SHOPPING = "shopping"


def month(day: Column) -> Column:
    return F.trunc(day, "MM")


def _lines(lines: bool, condition: Column | None = None) -> Column:
    if not lines:
        return F.array().cast("array<long>")
    return F.array_sort(F.collect_list(F.col("line_number") if condition is None else F.when(condition, F.col("line_number"))))


def category_lines(transactions: DataFrame) -> DataFrame:
    """log_id, month, category and runs (first, last) of the lines behind each monthly category total."""
    rows = with_treatment(transactions, "included_spending").withColumn("month", month(F.col("occurred_on")))
    return line_sets.runs(rows, ["log_id", "month", "category"])


def month_lines(transactions: DataFrame) -> DataFrame:
    """Runs of the lines behind each monthly total."""
    rows = transactions.filter(F.col("treatment").isin("included_spending", "uncategorized_outflow")).withColumn("month", month(F.col("occurred_on")))
    return line_sets.runs(rows, ["log_id", "month"])


def treatment_lines(transactions: DataFrame) -> DataFrame:
    """Runs of the lines of each treatment."""
    return line_sets.runs(transactions, ["log_id", "treatment"])


def coverage_runs(transactions: DataFrame) -> DataFrame:
    """Runs of each month's lines that are Other only because the retailer is mixed."""
    return line_sets.runs(_covering(transactions).withColumn("month", month(F.col("occurred_on"))), ["log_id", "month"])


def _covering(transactions: DataFrame) -> DataFrame:
    return transactions.filter((F.col("treatment") == "included_spending") & (F.col("category") == "other") & (F.col("policy_note") == MIXED_NOTE))


def _sum(amount: Column) -> Column:
    return F.coalesce(F.sum(amount), F.lit(0)).cast(MONEY)


def with_treatment(transactions: DataFrame, name: str) -> DataFrame:
    return transactions.filter(F.col("treatment") == name)


def monthly_category_totals(transactions: DataFrame, lines: bool = False) -> DataFrame:
    rows = with_treatment(transactions, "included_spending")
    return rows.groupBy("log_id", month(F.col("occurred_on")).alias("month"), "category").agg(_sum(F.col("amount")).alias("amount"), _lines(lines).alias("lines"))


def monthly_totals(transactions: DataFrame, lines: bool = False) -> DataFrame:
    """Months that hold included spending or unresolved outflow; one aggregation over both."""
    rows = transactions.filter(F.col("treatment").isin("included_spending", "uncategorized_outflow"))
    amount = lambda t: _sum(F.when(F.col("treatment") == t, F.col("amount")))
    return rows.groupBy("log_id", month(F.col("occurred_on")).alias("month")).agg(
        amount("included_spending").alias("classified"), amount("uncategorized_outflow").alias("unresolved"), _sum(F.col("amount")).alias("observed"), _lines(lines).alias("lines")
    )


def treatment_partition(transactions: DataFrame, lines: bool = False) -> DataFrame:
    """All five treatments of each log; one that no line has gets an empty list."""
    found = transactions.groupBy("log_id", "treatment").agg(F.count("*").alias("n"), _lines(lines).cast("array<long>").alias("lines"))
    every = found.select("log_id").distinct().select("log_id", F.explode(F.array(*map(F.lit, TREATMENTS))).alias("treatment"))
    out = every.join(found, ["log_id", "treatment"], "left")
    return out.select("log_id", "treatment", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("lines", F.array().cast("array<long>")).alias("lines"))


def reconciliation(transactions: DataFrame, category_totals: DataFrame, month_totals: DataFrame, lines: bool = False) -> DataFrame:
    """One row a log: line lists and counts by treatment, grand totals, refunds and whether everything adds up.

    Without ``lines`` it only counts, so that a log of any length is added up by partial sums.
    """
    names = {"included_spending": "included", "excluded_duplicate": "duplicates", "uncategorized_outflow": "unresolved_lines", "uncategorized_credit": "credits", "unparsed": "unparsed"}
    listed = [_lines(lines, F.col("treatment") == t).alias(name) for t, name in names.items()]
    counted = [F.count_if(F.col("treatment") == t).alias(f"n_{name}") for t, name in names.items()]
    refund = (F.col("treatment") == "included_spending") & (F.col("amount") < 0)
    refunds = _lines(lines, refund).alias("refunds")
    counted.append(F.count_if(refund).alias("n_refunds"))
    rows = transactions.groupBy("log_id").agg(F.count("*").alias("n_lines"), F.countDistinct("line_number").alias("distinct_lines"), *listed, *counted, refunds)
    by_category = category_totals.groupBy("log_id").agg(_sum(F.col("amount")).alias("classified"))
    by_month = month_totals.groupBy("log_id").agg(_sum(F.col("classified")).alias("monthly"), _sum(F.col("unresolved")).alias("unresolved"), _sum(F.col("observed")).alias("observed"))
    zero = F.lit(0).cast(MONEY)
    out = rows.join(by_category, "log_id", "left").join(by_month, "log_id", "left")
    out = out.withColumns({c: F.coalesce(c, zero) for c in ("classified", "monthly", "unresolved", "observed")})
    balanced = (
        (F.col("n_lines") == F.col("distinct_lines"))
        & (sum((F.col(f"n_{n}") for n in names.values()), F.lit(0)) == F.col("n_lines"))
        & (F.col("classified") == F.col("monthly"))
        & (F.col("classified") + F.col("unresolved") == F.col("observed"))
    )
    return out.withColumn("is_balanced", balanced).drop("distinct_lines", "monthly")


def coverage(transactions: DataFrame) -> DataFrame:
    """The same lines as lists, for notes that name them."""
    return _covering(transactions).groupBy("log_id", month(F.col("occurred_on")).alias("month")).agg(_lines(True).alias("coverage_lines"))


def budget_comparisons(category_totals: DataFrame, month_totals: DataFrame, targets: DataFrame, covered: DataFrame | None = None) -> DataFrame:
    """Every observed month with every target; a missing total is 0. targets (category, target) is small and broadcast."""
    months = month_totals.select("log_id", "month").crossJoin(F.broadcast(targets.select("category", "target")))
    out = months.join(category_totals.select("log_id", "month", "category", "amount", "lines"), ["log_id", "month", "category"], "left")
    actual = F.coalesce("amount", F.lit(0).cast(MONEY)).cast(MONEY)
    empty = F.array().cast("array<long>")
    out = out.select("log_id", "month", "category", F.col("target").cast(MONEY).alias("target"), actual.alias("actual"), F.coalesce(F.col("lines").cast("array<long>"), empty).alias("lines"))
    out = out.withColumn("variance", (F.col("actual") - F.col("target")).cast(MONEY))
    if covered is None:
        return out
    out = out.join(covered, ["log_id", "month"], "left")
    mine = F.when(F.col("category") == SHOPPING, F.col("coverage_lines"))
    out = out.withColumn("coverage_lines", F.coalesce(mine.cast("array<long>"), empty))
    text = F.concat(F.lit("Shopping coverage is incomplete because mixed-retailer charges are in Other (source lines "), F.array_join(F.col("coverage_lines").cast("array<string>"), ", "), F.lit(")."))
    return out.withColumn("coverage_note", F.when(F.size("coverage_lines") > 0, text))


def month_pairs(months: DataFrame) -> DataFrame:
    """Neighbouring observed months of each log, numbered from 1."""
    order = Window.partitionBy("log_id").orderBy("month")
    rows = months.select("log_id", "month").distinct().select("log_id", F.col("month").alias("from_month"), F.lead("month").over(order).alias("to_month"), F.row_number().over(order).alias("number"))
    return rows.filter("to_month is not null")


def month_deltas(category_totals: DataFrame, months: DataFrame) -> DataFrame:
    """Change of each category between neighbouring observed months: two equi-joins, met by a full outer join.

    The window runs over the distinct months of a log, of which there are few.
    """
    pairs = month_pairs(months)
    was = category_totals.select("log_id", F.col("month").alias("from_month"), "category", F.col("amount").alias("a"), F.col("lines").alias("la"))
    now = category_totals.select("log_id", F.col("month").alias("to_month"), "category", F.col("amount").alias("b"), F.col("lines").alias("lb"))
    keys = ["log_id", "from_month", "to_month", "category"]
    pairs = pairs.drop("number")
    both = pairs.join(was, ["log_id", "from_month"]).join(pairs.join(now, ["log_id", "to_month"]), keys, "full")
    zero, empty = F.lit(0).cast(MONEY), F.array().cast("array<long>")
    out = both.select(
        *keys,
        F.coalesce("a", zero).alias("previous"),
        F.coalesce("b", zero).alias("current"),
        F.array_sort(F.concat(F.coalesce(F.col("la").cast("array<long>"), empty), F.coalesce(F.col("lb").cast("array<long>"), empty))).alias("lines"),
    )
    return out.filter("previous <> 0 or current <> 0").withColumn("change", (F.col("current") - F.col("previous")).cast(MONEY))


def delta_order(deltas: DataFrame) -> DataFrame:
    return deltas.orderBy("log_id", "from_month", F.abs("change").desc(), "category")


def ranked_breaches(budgets: DataFrame) -> DataFrame:
    return budgets.filter("variance > 0").orderBy("log_id", F.col("variance").desc(), "month", "category")


def top_changes(deltas: DataFrame, n: int = 5) -> DataFrame:
    """The first n of each log by size of change, then month, then category."""
    order = Window.partitionBy("log_id").orderBy(F.abs("change").desc(), "to_month", "category")
    return deltas.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= n)


def largest_breach(budgets: DataFrame, category: str) -> DataFrame:
    """The largest breach of one category; ties go to the later month."""
    rows = budgets.filter((F.col("category") == category) & (F.col("variance") > 0))
    return rows.groupBy("log_id").agg(F.max(F.struct("variance", "month", "category", "actual", "target")).alias("top")).select("log_id", "top.*")


def largest_change(deltas: DataFrame) -> DataFrame:
    key = F.struct((-F.abs("change")).alias("k"), "to_month", "category", "from_month", "change")
    return deltas.groupBy("log_id").agg(F.min(key).alias("top")).select("log_id", "top.from_month", "top.to_month", "top.category", "top.change")


def largest_increase(deltas: DataFrame, from_month, to_month) -> DataFrame:
    rows = deltas.filter((F.col("from_month") == F.lit(from_month)) & (F.col("to_month") == F.lit(to_month)) & (F.col("change") > 0))
    return rows.groupBy("log_id").agg(F.min(F.struct((-F.col("change")).alias("k"), "category", "change")).alias("top")).select("log_id", "top.category", "top.change")
