"""Registered queries of grading: projections, fact readers, policies and the dispatch of checks."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import grading, policies, totals
from .registry import _LINES, _W, _graded_lines, joined, ledger, query, table, wide

_NAMES = "(VALUES ('dining_coffee', 'Dining'), ('shopping', 'Shop'), ('other', 'Rest')) n(category, reference_category)"


def _names(spark):
    return spark.createDataFrame([("dining_coffee", "Dining"), ("shopping", "Shop"), ("other", "Rest")], "category string, reference_category string")


@query(_W + f"SELECT line_number + 3 AS line_number, 'order' AS source_text, CAST(o_custkey AS VARCHAR) AS merchant, occurred_on, CAST(amount AS DECIMAL(38,2)) AS amount, treatment, reference_category AS category FROM tx LEFT JOIN {_NAMES} USING (category)")
def outcome_projection(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("line_number"), F.col("o_custkey").cast("string").alias("description"), F.lit("order").alias("source_text"))
    rows = grading.project(ledger(spark, sf_dir).join(o, "line_number"), _names(spark), 3)
    return rows.select("line_number", "source_text", "merchant", "occurred_on", wide("amount"), "treatment", "category")


@query(_W + f"SELECT reference_category AS category, strftime(m, '%Y-%m') AS period, CAST(amount AS DECIMAL(38,2)) AS amount, array_to_string(list_transform(lines, lambda x: x + 3), ',') AS lines FROM ct LEFT JOIN {_NAMES} USING (category)")
def bucket_projection(spark, sf_dir):
    rows = grading.project_buckets(totals.monthly_category_totals(ledger(spark, sf_dir), lines=True), _names(spark), 3)
    return rows.select("category", "period", wide("amount"), joined("lines").alias("lines"))


# Two policies: p1 may move every fifth click to view, p2 every seventh view to click.
_POLICIES = """e AS (SELECT event_id AS k, event_type AS c, CAST(value AS DECIMAL(18,2)) AS v, CASE WHEN event_type = 'click' AND event_id % 5 = 0 THEN 'p1' WHEN event_type = 'view' AND event_id % 7 = 0 THEN 'p2' END AS p FROM events),
  f AS (SELECT p, min(k) AS line FROM e WHERE p IS NOT NULL GROUP BY p), places AS (SELECT p, row_number() OVER (ORDER BY line) - 1 AS place FROM f),
  masks AS (SELECT range AS mask FROM range(0, 4)), subsets AS (SELECT mask, row_number() OVER (ORDER BY bit_count(CAST(mask AS INTEGER)), mask & 1 = 0, mask & 2 = 0) - 1 AS ordinal FROM masks),
  m AS (SELECT ordinal, k, v FROM subsets CROSS JOIN e LEFT JOIN places USING (p)
    WHERE CASE WHEN place IS NOT NULL AND (mask >> CAST(place AS INTEGER)) & 1 = 1 THEN CASE c WHEN 'click' THEN 'view' ELSE 'click' END ELSE c END = 'click'),
  run AS (SELECT k, v + CASE WHEN k % 97 = 0 THEN 1 ELSE 0 END AS v FROM e WHERE (c = 'click' AND k % 5 <> 0) OR k % 89 = 0),
  d AS (SELECT ordinal, k, CASE WHEN run.k IS NULL THEN 'missing' WHEN m.v IS NULL THEN 'extra' WHEN run.v <> m.v THEN 'misread' END AS kind,
      CASE WHEN run.k IS NULL THEN -m.v WHEN m.v IS NULL THEN run.v ELSE run.v - m.v END AS effect
    FROM (SELECT ordinal, k FROM m UNION SELECT ordinal, k FROM subsets CROSS JOIN run) x LEFT JOIN m USING (ordinal, k) LEFT JOIN run USING (k))"""


def _policy_differences(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    k, c = F.col("event_id"), F.col("event_type")
    policy = F.when((c == "click") & (k % 5 == 0), "p1").when((c == "view") & (k % 7 == 0), "p2")
    other = F.when(policy == "p1", F.array(F.lit("view"))).when(policy == "p2", F.array(F.lit("click")))
    reference = e.select(k.alias("line_number"), F.col("value").cast("decimal(18,2)").alias("amount"), c.alias("category"), F.lit("2024-01").alias("period"), F.lit(True).alias("is_counted"), policy.alias("policy_name"), other.alias("alternatives"))
    read = (F.col("value").cast("decimal(18,2)") + F.when(k % 97 == 0, 1).otherwise(0)).cast("decimal(18,2)")
    run = e.filter(((c == "click") & (k % 5 != 0)) | (k % 89 == 0)).select(k.alias("line_number"), read.alias("amount"))
    return policies.touching(reference, "click", "2024-01"), policies.separable_differences(reference, run, run, "click", "2024-01")


@query(f"WITH {_POLICIES} SELECT CAST(ordinal AS INTEGER) AS ordinal, k AS line_number, kind, CAST(effect AS DECIMAL(18,2)) AS effect FROM d WHERE kind IS NOT NULL")
def bucket_differences_by_policy(spark, sf_dir):
    accepted, gaps = _policy_differences(spark, sf_dir)
    subsets = grading.policy_subsets(accepted).select(F.col("ordinal").cast("int").alias("ordinal"), "applied")
    return policies.differences_by_subset(gaps, subsets).select("ordinal", "line_number", "kind", "effect")


@query(f"WITH {_POLICIES} SELECT CAST(ordinal AS INTEGER) AS ordinal, count(kind) AS n, CAST(coalesce(sum(effect) FILTER (kind IS NOT NULL), 0) AS DECIMAL(38,2)) AS effect FROM d GROUP BY ordinal ORDER BY n, ordinal LIMIT 1")
def fewest_policy_differences(spark, sf_dir):
    accepted, gaps = _policy_differences(spark, sf_dir)
    return policies.best_subset(policies.scores(gaps, accepted)).select(F.col("ordinal").cast("int").alias("ordinal"), "n", wide("effect"))


_TWENTY = """e AS (SELECT event_id AS k, event_type = 'click' AS own, event_id % 20 AS p, CAST(value AS DECIMAL(18,2)) AS v FROM events),
  s AS (SELECT k, p, v, own AS off_here, NOT own AS on_here, (k % 20 < 8) = own AS counted FROM e),
  d AS (SELECT p, count(*) FILTER (on_here <> counted) AS n_on, count(*) FILTER (off_here <> counted) AS n_off,
      coalesce(sum(CASE WHEN counted THEN v ELSE -v END) FILTER (on_here <> counted), 0) AS e_on, coalesce(sum(CASE WHEN counted THEN v ELSE -v END) FILTER (off_here <> counted), 0) AS e_off FROM s GROUP BY p)"""


@query(
    f"""WITH {_TWENTY}, f AS (SELECT p, min(k) AS line FROM e GROUP BY p)
        SELECT string_agg('p' || p, ',' ORDER BY line) FILTER (n_on < n_off) AS applied, CAST(sum(least(n_on, n_off)) AS BIGINT) AS n, CAST(sum(CASE WHEN n_on < n_off THEN e_on ELSE e_off END) AS DECIMAL(38,2)) AS effect FROM d JOIN f USING (p)"""
)
def best_of_twenty_policies(spark, sf_dir):
    """Twenty policies, a million subsets: the best one from sums by policy. The run followed twelve of them."""
    e = table(spark, sf_dir, "events")
    k, click = F.col("event_id"), F.col("event_type") == "click"
    other = F.array(F.when(click, "view").otherwise("click"))
    reference = e.select(k.alias("line_number"), F.col("value").cast("decimal(18,2)").alias("amount"), F.col("event_type").alias("category"), F.lit("2024-01").alias("period"), F.lit(True).alias("is_counted"), F.concat(F.lit("p"), k % 20).alias("policy_name"), other.alias("alternatives"))
    run = e.filter((k % 20 < 8) == click).select(k.alias("line_number"), F.col("value").cast("decimal(18,2)").alias("amount"))
    gaps = policies.separable_differences(reference, run, run, "click", "2024-01")
    best = policies.best_subset(policies.scores(gaps, policies.touching(reference, "click", "2024-01")))
    return best.select(F.array_join("applied", ",").alias("applied"), "n", wide("effect"))


@query(
    """WITH l AS (SELECT event_id AS k, event_type, CAST(value AS DECIMAL(18,2)) AS v FROM events) SELECT k AS line_number,
       concat_ws(',', CASE WHEN k % 11 = 0 THEN 'missing' END, CASE WHEN k % 11 <> 0 AND k % 6 = 0 THEN 'merchant' END, CASE WHEN k % 11 <> 0 AND k % 8 = 0 THEN 'counted' END,
         CASE WHEN k % 11 <> 0 AND k % 10 = 0 AND event_type <> 'view' THEN 'category' END) AS differences FROM l
       WHERE k % 11 = 0 OR k % 6 = 0 OR k % 8 = 0 OR (k % 10 = 0 AND event_type <> 'view')"""
)
def line_differences(spark, sf_dir):
    """Lines of a run against the reference: missing, another merchant, wrongly left out, or a category nobody accepts."""
    lines = _graded_lines(spark, sf_dir).withColumn("treatment", F.lit("included_spending"))
    k, day = F.col("line_number"), F.lit("2024-01-02").cast("date")
    reference = lines.select(k, F.lit("t").alias("source_text"), day.alias("occurred_on"), F.lit("m").alias("merchant"), "amount", F.lit(True).alias("is_counted"), "category", F.array(F.lit("view")).alias("alternatives"))
    made = lines.filter(k % 11 != 0).select(k, F.lit("t").alias("source_text"), day.alias("occurred_on"), F.when(k % 6 == 0, "x").otherwise("m").alias("merchant"), "amount", F.when(k % 8 == 0, "excluded_duplicate").otherwise(F.col("treatment")).alias("treatment"),
                                            F.when((k % 10 == 0) & (F.col("category") != "view"), "none").otherwise(F.when(k % 10 == 1, "view").otherwise(F.col("category"))).alias("category"))
    return grading.line_differences(reference, made).select("line_number", F.array_join("differences", ",").alias("differences"))


_TABLES = f"""{_LINES}, runs AS (SELECT DISTINCT run FROM l), bucket AS (SELECT run, category, '2024-01' AS period, sum(amount) AS amount FROM l WHERE treatment = 'included_spending' GROUP BY ALL)"""
READERS = "fact_name string, reader string, category string, period string, from_period string, to_period string, line_numbers array<long>"


def _outcomes(spark, sf_dir):
    lines = _graded_lines(spark, sf_dir)
    counted = lines.filter("treatment = 'included_spending'").groupBy("run", "category").agg(F.sum("amount").cast("decimal(18,2)").alias("amount"))
    buckets = counted.select("run", "category", F.lit("2024-01").alias("period"), "amount")
    budgets = buckets.filter("category in ('click', 'view')").select("run", "category", "period", F.col("amount").alias("actual"), F.when(F.col("run") % 4 == 3, 1).otherwise(3000).cast("decimal(18,2)").alias("target"))
    changes = buckets.select("run", "category", F.lit("2024-01").alias("from_period"), F.lit("2024-02").alias("to_period"), (F.col("amount") - 3000).cast("decimal(18,2)").alias("change"))
    return lines, buckets, budgets, changes


@query(
    f"""WITH {_TABLES} SELECT run, 'spent' AS fact_name, CASE WHEN amount > CASE WHEN run % 4 = 3 THEN 1 ELSE 3000 END THEN 'over' ELSE 'under' END AS fact_value FROM bucket WHERE category = 'click'
      UNION ALL SELECT run, 'unstated', 'not_stated' FROM runs
      UNION ALL SELECT run, 'refund', CASE WHEN treatment IS NULL THEN 'not_mentioned' WHEN treatment <> 'included_spending' OR amount IS NULL THEN 'excluded' WHEN amount < 0 THEN 'netted_against_spending' ELSE 'counted_as_purchase' END FROM runs LEFT JOIN (SELECT * FROM l WHERE line_number = 21) x USING (run)
      UNION ALL SELECT run, 'out', CAST(coalesce(treatment = 'excluded_duplicate', false) AS VARCHAR) FROM runs LEFT JOIN (SELECT * FROM l WHERE line_number = 11) x USING (run)
      UNION ALL SELECT run, 'counted', CAST(count(*) FILTER (line_number IN (2, 12) AND treatment = 'included_spending') = 2 AS VARCHAR) FROM l GROUP BY run
      UNION ALL SELECT run, 'uncategorized', CAST(count(*) FILTER (treatment LIKE 'uncategorized%') AS VARCHAR) FROM l GROUP BY run
      UNION ALL SELECT run, 'up', arg_min(category, (-amount, category)) FILTER (amount > 3000) FROM bucket GROUP BY run"""
)
def fact_readers(spark, sf_dir):
    """All six readers, and one that finds nothing."""
    lines, _, budgets, changes = _outcomes(spark, sf_dir)
    rows = [
        ("spent", "budget_status", "click", "2024-01", None, None, None),
        ("unstated", "budget_status", "click", "1999-01", None, None, None),
        ("refund", "refund_treatment", None, None, None, None, [21]),
        ("out", "duplicate_excluded", None, None, None, None, [11]),
        ("counted", "lines_counted", None, None, None, None, [2, 12]),
        ("uncategorized", "uncategorized_count", None, None, None, None, None),
        ("up", "largest_increase", None, None, "2024-01", "2024-02", None),
    ]
    return grading.read_facts(spark.createDataFrame(rows, READERS), lines, budgets, changes)


@query(
    f"""WITH {_LINES}, t AS (SELECT r.run, line_number, treatment, amount, category, line_number % (10 + r.run) = 0 AS moved FROM l CROSS JOIN (VALUES (1), (2), (3)) r(run)),
      bucket AS (SELECT run, category, sum(amount) AS amount FROM t WHERE treatment = 'included_spending' GROUP BY ALL),
      n AS (SELECT run, count(*) FILTER (treatment LIKE 'uncategorized%') AS open,
        count(*) FILTER (moved AND category = 'click' AND treatment = 'included_spending') + count(*) FILTER (category = 'click' AND NOT moved AND treatment = 'uncategorized_outflow')
        + count(*) FILTER (category <> 'click' AND moved AND treatment <> 'excluded_duplicate') AS wrong,
        count(*) FILTER (moved OR treatment = 'uncategorized_outflow') AS differing FROM t GROUP BY run)
      SELECT run, 'sum' AS check_name, CASE WHEN run = 2 THEN 'passed' ELSE 'failed' END AS status,
        'Clicks. Expected 1 or ' || (SELECT amount FROM bucket WHERE run = 2 AND category = 'click') || ' (within 0.01); the run reported ' || CASE WHEN run = 3 THEN 'no total' ELSE CAST(amount + CASE WHEN run = 1 THEN 5 ELSE 0 END AS VARCHAR) END || ' for click 2024-01.' AS reason
        FROM bucket WHERE category = 'click'
      UNION ALL SELECT run, 'fact', CASE WHEN open = 0 THEN 'passed' ELSE 'failed' END, 'Open. Expected 0 (any case); the run''s result gives ' || open || '.' FROM n
      UNION ALL SELECT run, 'category', CASE WHEN wrong = 0 THEN 'passed' ELSE 'failed' END, 'Place. ' || wrong || ' lines of click differ.' FROM n
      UNION ALL SELECT run, 'lines', CASE WHEN differing = 0 THEN 'passed' ELSE 'failed' END, 'All. ' || differing || ' lines differ.' FROM n
      UNION ALL SELECT run, 'targets', CASE WHEN run = 3 THEN 'failed' ELSE 'passed' END, 'Targets. ' || CASE WHEN run = 3 THEN '2 targets invented, 2' ELSE '0 targets invented, 0' END || ' missing.' FROM n
      UNION ALL SELECT run, 'judge', CASE run WHEN 3 THEN 'errored' WHEN 1 THEN 'passed' ELSE 'failed' END, CASE WHEN run = 3 THEN 'the judge did not return a verdict: busy' ELSE 'Tone. The judge said: ' || run END FROM n"""
)
def graded_run(spark, sf_dir):
    """All kinds of checks over three runs, each of which puts other lines in the wrong place."""
    lines = _graded_lines(spark, sf_dir).drop("run")
    k, run, day = F.col("line_number"), F.col("run"), F.lit("2024-01-02").cast("date")
    plain = lines.select(k, F.lit("t").alias("source_text"), day.alias("occurred_on"), F.lit("m").alias("merchant"), "amount", "treatment", "category")
    reference = plain.withColumn("is_counted", F.col("treatment") == "included_spending").withColumn("alternatives", F.lit(None).cast("array<string>")).drop("treatment")
    outcomes = grading.repeated_trials(plain, 3)
    placed = F.when(k % (10 + run) == 0, F.when(F.col("category") == "click", "view").otherwise("click")).otherwise(F.col("category"))
    counted = outcomes.filter("treatment = 'included_spending'").groupBy("run", "category").agg(F.sum("amount").cast("decimal(18,2)").alias("amount"))
    truth = counted.select("run", "category", F.lit("2024-01").alias("period"), "amount")
    buckets = truth.filter((run < 3) | (F.col("category") != "click")).withColumn("amount", (F.col("amount") + F.when(run == 1, 5).otherwise(0)).cast("decimal(18,2)"))
    budgets = truth.filter("category in ('click', 'view')").withColumnRenamed("amount", "actual").withColumn("target", F.when(run == 3, 1).otherwise(3000).cast("decimal(18,2)"))
    changes = truth.limit(0).select("run", "category", F.lit("").alias("from_period"), F.lit("").alias("to_period"), F.col("amount").alias("change"))
    total = F.sum("amount").cast("decimal(18,2)").cast("string")
    right = plain.filter("treatment = 'included_spending' and category = 'click'").agg(F.array(F.lit("1"), total).alias("right"))
    none = [None] * 5
    rows = [
        ("sum", "amount", "Clicks.", None, "click", "2024-01", None, None, None, None, None),
        ("fact", "fact_value", "Open.", "uncategorized_count", *none, ["0"], None),
        ("category", "ledger_category", "Place.", None, "click", *none, None),
        ("lines", "ledger_lines", "All.", None, *none, None, None),
        ("targets", "budget_targets", "Targets.", None, *none, None, {"click": 3000, "view": 3000}),
        ("judge", "judge", "Tone.", None, *none, None, None),
        ("never", "not_applicable", "None.", None, *none, None, None),
    ]
    checks = spark.createDataFrame(rows, grading.CHECKS.replace("decimal(18,2)", "int")).withColumn("targets", F.col("targets").cast("map<string,decimal(18,2)>"))
    checks = checks.crossJoin(right).withColumn("accepted", F.when(F.col("kind") == "amount", F.col("right")).otherwise(F.col("accepted"))).drop("right")
    judged = outcomes.select("run").distinct().select("run", F.lit("judge").alias("check_name"), F.when(run < 3, run == 1).alias("passed"), F.when(run == 3, "busy").otherwise(run.cast("string")).alias("said"))
    return grading.grade_run(checks, reference, outcomes.withColumn("category", placed), buckets, budgets, changes, judged)
