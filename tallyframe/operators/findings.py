"""Evidence statements, the ones that must be reported, and the choice of three findings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.formatting import category_name, finding_money, month_name
from . import totals

FINDINGS = 3
COVERAGE_ID = "shopping-coverage"


def budget_id(month: Column, category: Column) -> Column:
    return F.concat(F.lit("budget-"), month.cast("string"), F.lit("-"), category)


def change_id(from_month: Column, to_month: Column, category: Column) -> Column:
    return F.concat(F.lit("change-"), from_month.cast("string"), F.lit("-"), to_month.cast("string"), F.lit("-"), category)


def _texts(*parts) -> Column:
    return F.concat(*(p if isinstance(p, Column) else F.lit(p) for p in parts))


def budget_evidence(budgets: DataFrame) -> DataFrame:
    """Breaches, largest first, then by month and category."""
    order = Window.partitionBy("log_id").orderBy(F.col("variance").desc(), "month", "category")
    side = F.when(F.col("variance") > 0, "over").otherwise("under")
    text = _texts("In ", month_name(F.col("month")), ", ", category_name(F.col("category")), " was ", finding_money(F.col("actual")), " against a ", finding_money(F.col("target")), " monthly target, ", finding_money(F.abs("variance")), " ", side, " target.")
    rows = budgets.filter("variance > 0")
    return rows.select("log_id", F.lit(0).alias("part"), F.row_number().over(order).alias("place"), budget_id(F.col("month"), F.col("category")).alias("evidence_id"), text.alias("statement"), F.col("lines").cast("array<long>").alias("lines"))


def change_evidence(deltas: DataFrame, n: int = 5) -> DataFrame:
    way = F.when(F.col("change") > 0, "rose").when(F.col("change") < 0, "fell").otherwise("did not change")
    text = _texts("From ", month_name(F.col("from_month")), " to ", month_name(F.col("to_month")), ", ", category_name(F.col("category")), " ", way, " by ", finding_money(F.abs("change")), ", from ", finding_money(F.col("previous")), " to ", finding_money(F.col("current")), ".")
    rows = totals.top_changes(deltas, n)
    return rows.select("log_id", F.lit(1).alias("part"), F.col("rank").alias("place"), change_id(F.col("from_month"), F.col("to_month"), F.col("category")).alias("evidence_id"), text.alias("statement"), F.col("lines").cast("array<long>").alias("lines"))


def months_under(budgets: DataFrame, category: str = totals.SHOPPING) -> DataFrame:
    """In how many reported months a category stayed below its target."""
    return budgets.filter(F.col("category") == category).groupBy("log_id").agg(*_under())


def _under() -> list[Column]:
    return [F.count_if(F.col("variance") < 0).alias("under"), F.count("*").alias("months")]


def coverage_evidence(budgets: DataFrame) -> DataFrame:
    """One statement a log, where mixed-retailer charges leave Shopping incomplete."""
    rows = budgets.filter(F.col("category") == totals.SHOPPING)
    every = F.array_sort(F.array_distinct(F.flatten(F.collect_list(F.concat(F.col("lines").cast("array<long>"), F.col("coverage_lines").cast("array<long>"))))))
    rows = rows.groupBy("log_id").agg(*_under(), F.count("coverage_note").alias("noted"), every.alias("lines"))
    text = _texts("Shopping was below its stated monthly target in ", F.col("under").cast("string"), " of ", F.col("months").cast("string"), " reported months. These Shopping totals exclude merchant-only mixed-retailer charges assigned to Other, so the comparison does not cover all shopping-like purchases.")
    return rows.filter("noted > 0").select("log_id", F.lit(2).alias("part"), F.lit(1).alias("place"), F.lit(COVERAGE_ID).alias("evidence_id"), text.alias("statement"), "lines")


def fallback_evidence(reconciliation: DataFrame) -> DataFrame:
    listed = lambda c: F.col(c).cast("array<long>")
    spending = _texts("Classified spending totaled ", finding_money(F.col("classified")), " across the reported period.")
    unresolved = _texts("Unresolved outflows totaled ", finding_money(F.col("unresolved")), " and were kept separate from classified spending.")
    size = lambda c: F.col(f"n_{c}").cast("string")
    cover = _texts("The analysis accounted for ", F.col("n_lines").cast("string"), " source lines, including ", size("duplicates"), " excluded duplicates and ", size("unparsed"), " unparsed lines.")
    numbers = F.when(F.col("n_lines") > 0, F.sequence(F.lit(1).cast("long"), F.col("n_lines"))).otherwise(F.array().cast("array<long>"))
    rows = [("reconciliation-spending", spending, listed("included")), ("reconciliation-unresolved", unresolved, listed("unresolved_lines")), ("reconciliation-coverage", cover, numbers)]
    packed = F.array(*(F.struct(F.lit(k + 1).alias("place"), F.lit(i).alias("evidence_id"), t.alias("statement"), n.alias("lines")) for k, (i, t, n) in enumerate(rows)))
    return reconciliation.select("log_id", F.lit(3).alias("part"), F.inline(packed))


def evidence(budgets: DataFrame, deltas: DataFrame, reconciliation: DataFrame) -> DataFrame:
    """All statements in order: breaches, changes, coverage, three fallbacks; ``ordinal`` counts from 1 in each log."""
    rows = budget_evidence(budgets).unionByName(change_evidence(deltas)).unionByName(coverage_evidence(budgets)).unionByName(fallback_evidence(reconciliation))
    order = Window.partitionBy("log_id").orderBy("part", "place")
    return rows.withColumn("ordinal", F.row_number().over(order)).drop("part", "place")


def required_ids(budgets: DataFrame, deltas: DataFrame, logs: DataFrame) -> DataFrame:
    """Each log's required evidence ids: largest dining breach, largest change, coverage; distinct, at most three."""
    breach = totals.largest_breach(budgets, "dining_coffee").select("log_id", budget_id(F.col("month"), F.col("category")).alias("a"))
    change = totals.largest_change(deltas).select("log_id", change_id(F.col("from_month"), F.col("to_month"), F.col("category")).alias("b"))
    cover = coverage_evidence(budgets).select("log_id", F.col("evidence_id").alias("c"))
    rows = logs.join(breach, "log_id", "left").join(change, "log_id", "left").join(cover, "log_id", "left")
    return rows.select("log_id", F.slice(F.array_distinct(F.array_compact(F.array("a", "b", "c"))), 1, FINDINGS).alias("required"))


def default_selection(evidence_rows: DataFrame, required: DataFrame) -> DataFrame:
    """Required ids first, then evidence in order, until there are three: the choice when no model is asked."""
    ids = evidence_rows.groupBy("log_id").agg(F.array_sort(F.collect_list(F.struct("ordinal", "evidence_id"))).alias("e"))
    joined = required.join(ids, "log_id")
    every = F.array_distinct(F.concat("required", F.transform("e", lambda x: x["evidence_id"])))
    return joined.select("log_id", F.slice(every, 1, FINDINGS).alias("selected"))


def selection_problems(selection: DataFrame, evidence_rows: DataFrame, required: DataFrame) -> DataFrame:
    """Selections that are not three distinct, supplied ids with all required ones."""
    ids = evidence_rows.groupBy("log_id").agg(F.collect_set("evidence_id").alias("known"))
    rows = selection.join(ids, "log_id", "left").join(required, "log_id", "left")
    wrong = F.array_compact(
        F.array(
            F.when(F.size(F.array_distinct("selected")) != FINDINGS, "ids are not three distinct ones"),
            F.when(F.size(F.array_except("selected", F.coalesce("known", F.array().cast("array<string>")))) > 0, "unsupported ids"),
            F.when(F.size(F.array_except("required", "selected")) > 0, "required ids omitted"),
        )
    )
    return rows.select("log_id", wrong.alias("problems")).filter(F.size("problems") > 0)


def findings(selection: DataFrame, evidence_rows: DataFrame) -> DataFrame:
    """Selected statements in the selection's order; the text always comes from the evidence."""
    chosen = selection.select("log_id", F.posexplode("selected").alias("pos", "evidence_id"))
    return chosen.join(evidence_rows, ["log_id", "evidence_id"]).select("log_id", (F.col("pos") + 1).alias("number"), "evidence_id", "statement", "lines")
