"""Grading of a run's ledger against a reference ledger, and scorecards over repeated runs.

Outcomes: lines (run, line_number, source_text, merchant, occurred_on, amount, treatment, category), buckets (run, category,
period, amount, lines), budgets (run, category, period, target, actual), changes (run, category, from_period, to_period, change).
Reference: (line_number, source_text, merchant, occurred_on, amount, category, period, is_counted, policy_name, alternatives).
"""

from __future__ import annotations

import time
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.formatting import duration_text, within_tolerance
from ..functions.formatting import period as period_of
from . import selection

#: Fixed value: amounts nearer than this are equal.
TOLERANCE = "0.01"
UNCATEGORIZED = ("uncategorized_outflow", "uncategorized_credit")


def is_counted(treatment: Column) -> Column:
    """A reported line counts unless it is an excluded duplicate."""
    return treatment != "excluded_duplicate"


def project(transactions: DataFrame, names: DataFrame, offset: int = 0) -> DataFrame:
    """Lines renumbered to the input file and categories renamed; names: category, reference_category (small)."""
    rows = transactions.join(names, "category", "left")
    return rows.select((F.col("line_number") + offset).alias("line_number"), "source_text", F.col("description").alias("merchant"), "occurred_on", "amount", "treatment", F.col("reference_category").alias("category"))


def project_buckets(category_totals: DataFrame, names: DataFrame, offset: int = 0) -> DataFrame:
    rows = category_totals.join(names, "category", "left")
    return rows.select(F.col("reference_category").alias("category"), period_of(F.col("month")).alias("period"), "amount", F.transform("lines", lambda x: x + offset).alias("lines"))


def ledger_diff(reference: DataFrame, produced: DataFrame, key: list[str], columns: list[str], equal: dict[str, Column] | None = None) -> DataFrame:
    """Rows that differ, with the names of what differs: ``missing`` in the produced side, ``extra``, or columns.

    ``equal`` gives conditions for columns that are not compared as they are (r_ and p_ are the sides' prefixes).
    """
    r = reference.select(*key, *(F.col(c).alias(f"r_{c}") for c in reference.columns if c not in key), F.lit(True).alias("_r"))
    p = produced.select(*key, *(F.col(c).alias(f"p_{c}") for c in produced.columns if c not in key), F.lit(True).alias("_p"))
    both = r.join(p, key, "full")
    here = F.col("_r").isNotNull() & F.col("_p").isNotNull()
    same = {c: (equal or {}).get(c, F.col(f"r_{c}").eqNullSafe(F.col(f"p_{c}"))) for c in columns}
    labels = F.array_compact(F.array(F.when(F.col("_p").isNull(), "missing"), F.when(F.col("_r").isNull(), "extra"), *(F.when(here & ~F.coalesce(s, F.lit(False)), c) for c, s in same.items())))
    return both.withColumn("differences", labels).filter(F.size("differences") > 0).drop("_r", "_p")


def line_differences(reference: DataFrame, lines: DataFrame) -> DataFrame:
    """Ledger diff of lines: date, merchant, amount, counted or not, and category (any accepted one)."""
    ref = reference.withColumn("counted", F.col("is_counted")).withColumn("accepted", accepted_categories())
    ref = ref.select("line_number", "source_text", "occurred_on", "merchant", "amount", "counted", "category", "accepted")
    out = lines.withColumn("counted", is_counted(F.col("treatment")))
    return ledger_diff(ref, out, ["line_number"], ["occurred_on", "merchant", "amount", "counted", "category"], {"category": F.array_contains("r_accepted", F.col("p_category"))})


def accepted_categories() -> Column:
    return F.concat(F.array("category"), F.coalesce("alternatives", F.array().cast("array<string>")))


def policy_subsets(policies: DataFrame, group: list[str] | None = None) -> DataFrame:
    """Every subset of a group's few policies, none first, then by size: ordinal and names.

    policies: name, place (from 0, under 20) and the group columns.
    """
    group = group or []
    sizes = policies.groupBy(*group).agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "name"))), lambda x: x["name"]).alias("names"))
    masks = sizes.withColumn("mask", F.explode(F.sequence(F.lit(0).cast("long"), F.expr("shiftleft(1L, size(names)) - 1"))))
    bits = F.transform("names", lambda n, i: F.getbit("mask", i))
    picked = F.filter("names", lambda n, i: F.getbit("mask", i) == 1)
    rows = masks.select(*group, picked.alias("applied"), F.bit_count("mask").alias("size"), F.transform(bits, lambda b: 1 - b).alias("order"))
    window = Window.partitionBy(*group).orderBy("size", "order") if group else Window.orderBy("size", "order")
    return rows.withColumn("ordinal", F.row_number().over(window) - 1).drop("size", "order")


def unexplained(reported: Column, reference: Column, effect: Column) -> Column:
    """What a bucket's difference leaves open after its lines; null within the tolerance."""
    rest = reported - reference - effect
    return F.when(F.abs(rest) > F.lit(TOLERANCE).cast("decimal(18,2)"), rest)


def category_differences(reference: DataFrame, lines: DataFrame, category: str) -> DataFrame:
    """Counted reference lines of a category that lie elsewhere, and lines wrongly put there."""
    ref = reference.withColumn("accepted", accepted_categories())
    mine = ref.filter(F.col("is_counted") & (F.col("category") == category))
    counted = lines.filter(is_counted(F.col("treatment")))
    placed = mine.select("line_number", "accepted").join(counted.select("line_number", F.col("category").alias("c")), "line_number", "left")
    away = placed.filter(~F.coalesce(F.array_contains("accepted", F.col("c")), F.lit(False))).select("line_number", F.lit("elsewhere").alias("kind"))
    there = counted.filter(F.col("category") == category).join(mine, "line_number", "left_anti")
    wrong = there.join(ref.select("line_number", F.col("is_counted").alias("i"), "accepted"), "line_number", "left")
    wrong = wrong.filter(~F.coalesce(F.col("i") & F.array_contains("accepted", F.lit(category)), F.lit(False))).select("line_number", F.lit("wrongly here").alias("kind"))
    return away.unionByName(wrong)


def set_differences(used: DataFrame, expected: DataFrame) -> DataFrame:
    """Rows of one side only: ``invented`` and ``missing``."""
    return used.subtract(expected).withColumn("side", F.lit("invented")).unionByName(expected.subtract(used).withColumn("side", F.lit("missing")))


def read_facts(readers: DataFrame, lines: DataFrame, budgets: DataFrame, changes: DataFrame) -> DataFrame:
    """run, fact_name and fact_value for each reader and run.

    readers: fact_name, reader, category, period, from_period, to_period, line_numbers; few rows, broadcast.
    """
    runs = lines.select("run").distinct()
    asked = runs.crossJoin(readers)
    of = lambda name: asked.filter(F.col("reader") == name)
    spent = of("budget_status").join(budgets.select("run", "category", "period", "actual", "target"), ["run", "category", "period"], "left")
    status = F.when(F.col("actual").isNull(), "not_stated").when(F.col("actual") > F.col("target"), "over").otherwise("under")
    parts = [spent.select("run", "fact_name", status.alias("fact_value"))]
    one = lines.select("run", "line_number", "treatment", "amount")
    listed = asked.filter(F.col("reader").isin("refund_treatment", "duplicate_excluded", "lines_counted")).select("run", "fact_name", "reader", F.explode("line_numbers").alias("line_number")).join(one, ["run", "line_number"], "left")
    included = F.coalesce(F.col("treatment") == "included_spending", F.lit(False))
    refund = F.when(F.col("treatment").isNull(), "not_mentioned").when(~included | F.col("amount").isNull(), "excluded").when(F.col("amount") < 0, "netted_against_spending").otherwise("counted_as_purchase")
    facts = listed.groupBy("run", "fact_name", "reader").agg(F.bool_and(included).alias("all_in"), F.bool_and(F.coalesce(F.col("treatment") == "excluded_duplicate", F.lit(False))).alias("all_out"), F.first(refund).alias("refund"))
    value = F.when(F.col("reader") == "refund_treatment", F.col("refund")).when(F.col("reader") == "duplicate_excluded", F.col("all_out").cast("string")).otherwise(F.col("all_in").cast("string"))
    parts.append(facts.select("run", "fact_name", value.alias("fact_value")))
    n = lines.groupBy("run").agg(F.count_if(F.col("treatment").isin(*UNCATEGORIZED)).cast("string").alias("fact_value"))
    parts.append(of("uncategorized_count").join(n, "run").select("run", "fact_name", "fact_value"))
    ups = of("largest_increase").select("run", "fact_name", "from_period", "to_period").join(changes.filter("change > 0").select("run", "from_period", "to_period", "category", "change"), ["run", "from_period", "to_period"], "left")
    parts.append(ups.groupBy("run", "fact_name").agg(F.min_by("category", F.struct((-F.col("change")).alias("k"), "category")).alias("fact_value")))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def grade_amounts(checks: DataFrame, buckets: DataFrame, runs: DataFrame) -> DataFrame:
    """checks: check_name, category, period, accepted (decimals)."""
    rows = runs.crossJoin(checks).join(buckets.select("run", "category", "period", "amount"), ["run", "category", "period"], "left")
    return rows.select("run", "check_name", F.when(within_tolerance(F.col("amount"), F.col("accepted"), TOLERANCE), "passed").otherwise("failed").alias("status"))


def grade_facts(checks: DataFrame, facts: DataFrame) -> DataFrame:
    """checks: check_name, fact_name, accepted (texts, compared in any case)."""
    rows = facts.join(checks, "fact_name")
    good = F.exists("accepted", lambda x: F.lower(x) == F.lower(F.col("fact_value")))
    return rows.select("run", "check_name", F.when(F.coalesce(good, F.lit(False)), "passed").otherwise("failed").alias("status"))


def grade_empty(check_name: str, differences: DataFrame, runs: DataFrame) -> DataFrame:
    """A check that passes where a run has no difference. differences: run and anything."""
    failed = differences.select("run").distinct().withColumn("_f", F.lit(True))
    return runs.join(failed, "run", "left").select("run", F.lit(check_name).alias("check_name"), F.when(F.col("_f"), "failed").otherwise("passed").alias("status"))


def grade_judgments(judgments: DataFrame) -> DataFrame:
    """judgments: run, check_name, passed (null: the judge gave no verdict)."""
    return judgments.select("run", "check_name", F.when(F.col("passed").isNull(), "errored").when(F.col("passed"), "passed").otherwise("failed").alias("status"))


def graded(*parts: DataFrame) -> DataFrame:
    """All checks' grades as one table (run, check_name, status)."""
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def errored(checks: DataFrame, runs: DataFrame) -> DataFrame:
    """Every check of runs that failed before they could be graded."""
    return runs.crossJoin(checks.select("check_name")).select("run", "check_name", F.lit("errored").alias("status"))


def scorecard(grades: DataFrame, minimum: DataFrame) -> DataFrame:
    """Pass rates by check; an errored check stays in the denominator. minimum: check_name, minimum_pass_rate."""
    rows = grades.groupBy("check_name").agg(F.count("*").alias("runs"), F.count_if(F.col("status") == "passed").alias("passed"), F.count_if(F.col("status") == "errored").alias("errored"))
    out = rows.join(minimum, "check_name", "left").withColumn("pass_rate", F.when(F.col("runs") > 0, F.col("passed") / F.col("runs")).otherwise(0.0))
    return out.withColumn("meets_minimum", F.col("pass_rate") >= F.coalesce("minimum_pass_rate", F.lit(0.0)))


def timing_summary(timings: DataFrame, group: list[str], seconds: str = "seconds", completed: Column | None = None, few: int = selection.FEW) -> DataFrame:
    """Exact median, minimum, maximum and number of completed runs' durations; large groups' medians are narrowed down."""
    value = F.col(seconds) if completed is None else F.when(completed, F.col(seconds))
    sums = timings.groupBy(*group).agg(F.min(value).alias("minimum"), F.max(value).alias("maximum"), F.count(value).alias("n"))
    middle = selection.medians(timings, group, value, few)
    middle = middle.select(*(F.col(g).alias(f"_g{i}") for i, g in enumerate(group)), "median")
    same = reduce(lambda a, b: a & b, (F.col(g).eqNullSafe(F.col(f"_g{i}")) for i, g in enumerate(group)), F.lit(True))
    return sums.join(middle, same, "left").select(*group, "median", "minimum", "maximum", "n")


def timing_texts(summary: DataFrame, runs: DataFrame, group: list[str]) -> DataFrame:
    """``median (minimum to maximum), n of m runs`` of each group; runs: the group and all its runs, completed or not."""
    every = runs.groupBy(*group).agg(F.count("*").alias("m"))
    of = F.concat(F.col("n").cast("string"), F.lit(" of "), F.col("m").cast("string"), F.lit(" runs"))
    text = F.concat(duration_text(F.col("median")), F.lit(" ("), duration_text(F.col("minimum")), F.lit(" to "), duration_text(F.col("maximum")), F.lit("), "), of)
    return every.join(summary, group, "left").select(*group, F.when(F.col("n") > 0, text).otherwise(F.concat(F.lit("no completed runs of "), F.col("m").cast("string"))).alias("timing"))


def latest_per_key(rows: DataFrame, key: list[str], order: list[Column]) -> DataFrame:
    """The newest row of each key (``order`` first is newest)."""
    return rows.withColumn("_n", F.row_number().over(Window.partitionBy(*key).orderBy(*order))).filter("_n = 1").drop("_n")


def frequent(rows: DataFrame, key: list[str], more_than: int = 1) -> DataFrame:
    return rows.groupBy(*key).agg(F.count("*").alias("n")).filter(F.col("n") > more_than)


def repeated_trials(outcomes: DataFrame, n: int) -> DataFrame:
    """Saved outcomes once for each of n runs; live repetition belongs to the driver."""
    return outcomes.withColumn("run", F.explode(F.sequence(F.lit(1), F.lit(n))))


#: What a check is: which kind, and what that kind needs. Kinds: amount, fact_value, ledger_category, ledger_lines,
#: budget_targets, judge and not_applicable, which is never graded.
CHECKS = (
    "check_name string, kind string, description string, reader string, category string, period string, from_period string, to_period string, "
    "line_numbers array<long>, accepted array<string>, targets map<string,decimal(18,2)>"
)


def _verdict(passed: Column) -> Column:
    return F.when(F.coalesce(passed, F.lit(False)), "passed").otherwise("failed")


def _said(*parts) -> Column:
    return F.concat(*(F.coalesce(p.cast("string"), F.lit("none")) if isinstance(p, Column) else F.lit(p) for p in parts))


def _amount_checks(checks: DataFrame, runs: DataFrame, buckets: DataFrame) -> DataFrame:
    rows = runs.crossJoin(checks).join(buckets.select("run", "category", "period", "amount"), ["run", "category", "period"], "left")
    near = within_tolerance(F.col("amount"), F.transform("accepted", lambda x: x.cast("decimal(18,2)")), TOLERANCE)
    reason = _said(F.col("description"), " Expected ", F.array_join("accepted", " or "), f" (within {TOLERANCE}); the run reported ", F.coalesce(F.col("amount").cast("string"), F.lit("no total")), " for ", F.col("category"), " ", F.col("period"), ".")
    return rows.select("run", "check_name", _verdict(near).alias("status"), reason.alias("reason"))


def _fact_checks(checks: DataFrame, lines: DataFrame, budgets: DataFrame, changes: DataFrame) -> DataFrame:
    readers = checks.select(F.col("check_name").alias("fact_name"), "reader", "category", "period", "from_period", "to_period", "line_numbers")
    facts = read_facts(readers, lines, budgets, changes).withColumnRenamed("fact_name", "check_name")
    rows = facts.join(checks.select("check_name", "description", "accepted"), "check_name")
    good = F.exists("accepted", lambda x: F.lower(x) == F.lower(F.col("fact_value")))
    reason = _said(F.col("description"), " Expected ", F.array_join("accepted", " or "), " (any case); the run's result gives ", F.col("fact_value"), ".")
    return rows.select("run", "check_name", _verdict(good).alias("status"), reason.alias("reason"))


def _category_checks(checks: DataFrame, runs: DataFrame, reference: DataFrame, lines: DataFrame) -> DataFrame:
    """Counted reference lines of the category that a run has elsewhere, and lines that it wrongly put there."""
    ref = reference.select("line_number", F.col("category").alias("own"), "is_counted", accepted_categories().alias("accepted_here"))
    asked = checks.select("check_name", "category")
    mine = asked.join(ref.filter("is_counted"), F.col("category") == F.col("own"))
    counted = lines.filter(is_counted(F.col("treatment"))).select("run", "line_number", F.col("category").alias("placed"))
    away = runs.crossJoin(mine).join(counted, ["run", "line_number"], "left")
    away = away.filter(~F.coalesce(F.array_contains("accepted_here", F.col("placed")), F.lit(False))).select("run", "check_name", "line_number")
    there = counted.join(asked, F.col("placed") == F.col("category")).join(mine.select("check_name", "line_number"), ["check_name", "line_number"], "left_anti")
    wrong = there.join(ref, "line_number", "left").filter(~F.coalesce(F.col("is_counted") & F.array_contains("accepted_here", F.col("category")), F.lit(False)))
    n = away.unionByName(wrong.select("run", "check_name", "line_number")).groupBy("run", "check_name").agg(F.count("*").alias("n"))
    rows = runs.crossJoin(checks.select("check_name", "description", "category")).join(n, ["run", "check_name"], "left").withColumn("n", F.coalesce("n", F.lit(0)))
    return rows.select("run", "check_name", _verdict(F.col("n") == 0).alias("status"), _said(F.col("description"), " ", F.col("n"), " lines of ", F.col("category"), " differ.").alias("reason"))


def _line_checks(checks: DataFrame, runs: DataFrame, reference: DataFrame, lines: DataFrame) -> DataFrame:
    ref = runs.crossJoin(reference.withColumn("counted", F.col("is_counted")).withColumn("accepted", accepted_categories()))
    ref = ref.select("run", "line_number", "source_text", "occurred_on", "merchant", "amount", "counted", "category", "accepted")
    differing = ledger_diff(ref, lines.withColumn("counted", is_counted(F.col("treatment"))), ["run", "line_number"], ["occurred_on", "merchant", "amount", "counted", "category"], {"category": F.array_contains("r_accepted", F.col("p_category"))})
    n = differing.groupBy("run").agg(F.count("*").alias("n"))
    rows = runs.crossJoin(checks.select("check_name", "description")).join(n, "run", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    return rows.select("run", "check_name", _verdict(F.col("n") == 0).alias("status"), _said(F.col("description"), " ", F.col("n"), " lines differ.").alias("reason"))


def _target_checks(checks: DataFrame, runs: DataFrame, budgets: DataFrame) -> DataFrame:
    used = budgets.select("run", "category", F.col("target").cast("decimal(18,2)").alias("target")).distinct()
    expected = runs.crossJoin(checks.select("check_name", F.explode("targets").alias("category", "target")))
    keys = ["run", "check_name", "category", "target"]
    had = used.crossJoin(checks.select("check_name"))
    n = lambda a, b, name: a.select(*keys).join(b.select(*keys), keys, "left_anti").groupBy("run", "check_name").agg(F.count("*").alias(name))
    rows = runs.crossJoin(checks.select("check_name", "description")).join(n(had, expected, "invented"), ["run", "check_name"], "left").join(n(expected, had, "missing"), ["run", "check_name"], "left")
    rows = rows.fillna(0, ["invented", "missing"])
    return rows.select("run", "check_name", _verdict(F.col("invented") + F.col("missing") == 0).alias("status"), _said(F.col("description"), " ", F.col("invented"), " targets invented, ", F.col("missing"), " missing.").alias("reason"))


def _judge_checks(checks: DataFrame, runs: DataFrame, judgments: DataFrame) -> DataFrame:
    rows = runs.crossJoin(checks.select("check_name", "description")).join(judgments.select("run", "check_name", "passed", "said"), ["run", "check_name"], "left")
    none = F.col("passed").isNull()
    reason = F.when(none, _said("the judge did not return a verdict: ", F.col("said"))).otherwise(_said(F.col("description"), " The judge said: ", F.col("said")))
    return rows.select("run", "check_name", F.when(none, "errored").otherwise(_verdict(F.col("passed"))).alias("status"), reason.alias("reason"))


def grade_run(checks: DataFrame, reference: DataFrame, lines: DataFrame, buckets: DataFrame, budgets: DataFrame, changes: DataFrame, judgments: DataFrame) -> DataFrame:
    """run, check_name, status and reason of every check of every run.

    checks: as ``CHECKS``, a few rows. judgments: run, check_name, passed (null: no verdict), said. The other tables are
    outcomes and reference as this module has them.
    """
    runs = lines.select("run").distinct()
    of = lambda kind: checks.filter(F.col("kind") == kind)
    return graded(
        _amount_checks(of("amount"), runs, buckets),
        _fact_checks(of("fact_value"), lines, budgets, changes),
        _category_checks(of("ledger_category"), runs, reference, lines),
        _line_checks(of("ledger_lines"), runs, reference, lines),
        _target_checks(of("budget_targets"), runs, budgets),
        _judge_checks(of("judge"), runs, judgments),
    )


def timed_trials(spark: SparkSession, trial: Callable[[int], object], n: int) -> DataFrame:
    """run, seconds and failure of n isolated runs on the driver: one that fails is noted, and the others go on."""
    rows = []
    for run in range(1, n + 1):
        began, failure = time.monotonic(), None
        try:
            trial(run)
        except Exception as error:  # whatever a run does wrong belongs to that run
            failure = f"{type(error).__name__}: {error}"
        rows.append((run, time.monotonic() - began, failure))
    return spark.createDataFrame(rows, "run int, seconds double, failure string")


def graded_trials(spark: SparkSession, trial: Callable[[int], DataFrame], checks: list[str], n: int) -> tuple[DataFrame, DataFrame]:
    """Grades (run, check_name, status) and timings (run, seconds, failure) of n live runs, one after the other.

    ``trial`` analyses and grades one run: a row a check (check_name, status). A run that fails, or leaves a check out, has
    that check errored, and the others go on. Only grades, a few rows a run, come to the driver.
    """
    found: dict[int, dict[str, str]] = {}

    def once(run: int) -> None:
        found[run] = {r["check_name"]: r["status"] for r in trial(run).select("check_name", "status").limit(len(checks) + 1).collect()}

    timings = timed_trials(spark, once, n)
    rows = [(run, check, found.get(run, {}).get(check, "errored")) for run in range(1, n + 1) for check in checks]
    return spark.createDataFrame(rows, "run int, check_name string, status string"), timings
