"""Registered queries of the ledger engine over the star-schema tables, with their DuckDB equivalents.

Row numbers behind a figure are given as comma-joined text, so that both engines' results compare by value.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import evidence as ev
from ..functions import formatting as fm
from ..operators import compaction, findings, grading, line_sets, parsing, policies, policy, reconcile, rollout, selection, totals

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    """Registers a query under its function's name, with its SQL."""

    def add(function):
        QUERIES[function.__name__] = function
        if sql is not None:
            ORACLES[function.__name__] = sql
        return function

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def joined(lines) -> F.Column:
    return F.array_join(F.col(lines).cast("array<string>"), ",")


def wide(name: str) -> F.Column:
    return F.col(name).cast("decimal(38,2)").alias(name)


# --- orders as a ledger -------------------------------------------------------------------------------------------

TX = f"""
tx AS (
  SELECT o_orderkey AS line_number, CAST(o_orderdate AS DATE) AS occurred_on, CAST(date_trunc('month', o_orderdate) AS DATE) AS m,
         CAST(o_totalprice AS DECIMAL(18,2)) AS amount, o_custkey,
         CASE WHEN o_orderstatus = 'P' THEN 'uncategorized_outflow' WHEN o_custkey % 50 = 0 THEN 'excluded_duplicate'
              WHEN o_custkey % 61 = 0 THEN 'unparsed' ELSE 'included_spending' END AS treatment,
         CASE o_orderpriority WHEN '5-LOW' THEN 'other' WHEN '1-URGENT' THEN 'shopping' WHEN '2-HIGH' THEN 'dining_coffee'
              ELSE o_orderpriority END AS category,
         CASE WHEN o_orderpriority = '5-LOW' AND o_orderkey % 3 = 0 THEN '{policy.MIXED_NOTE}' END AS policy_note
  FROM orders
), ct AS (
  SELECT m, category, sum(amount) AS amount, list_sort(list(line_number)) AS lines FROM tx WHERE treatment = 'included_spending' GROUP BY ALL
), mt AS (
  SELECT m, coalesce(sum(amount) FILTER (treatment = 'included_spending'), 0) AS classified,
         coalesce(sum(amount) FILTER (treatment = 'uncategorized_outflow'), 0) AS unresolved, sum(amount) AS observed,
         list_sort(list(line_number)) AS lines
  FROM tx WHERE treatment IN ('included_spending', 'uncategorized_outflow') GROUP BY m
), tg AS (SELECT * FROM (VALUES ('dining_coffee', CAST(6900000 AS DECIMAL(18,2))), ('shopping', CAST(7100000 AS DECIMAL(18,2)))) t(category, target)
), bc AS (
  SELECT m, tg.category, target, coalesce(ct.amount, 0) AS actual, coalesce(ct.amount, 0) - target AS variance, ct.lines
  FROM mt CROSS JOIN tg LEFT JOIN ct USING (m, category)
), mp AS (SELECT m AS from_month, lead(m) OVER (ORDER BY m) AS to_month FROM mt
), cats AS (SELECT DISTINCT category FROM ct
), de AS (
  SELECT from_month, to_month, cats.category, coalesce(a.amount, 0) AS previous, coalesce(b.amount, 0) AS current,
         coalesce(b.amount, 0) - coalesce(a.amount, 0) AS change, list_sort(list_concat(coalesce(a.lines, []), coalesce(b.lines, []))) AS lines
  FROM mp CROSS JOIN cats LEFT JOIN ct a ON a.m = from_month AND a.category = cats.category LEFT JOIN ct b ON b.m = to_month AND b.category = cats.category
  WHERE to_month IS NOT NULL AND (coalesce(a.amount, 0) <> 0 OR coalesce(b.amount, 0) <> 0)
)"""
_W = f"WITH {TX}\n"


def ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    status, cust, level = F.col("o_orderstatus"), F.col("o_custkey"), F.col("o_orderpriority")
    return o.select(
        F.lit("orders").alias("log_id"),
        F.col("o_orderkey").alias("line_number"),
        F.col("o_orderdate").cast("date").alias("occurred_on"),
        F.col("o_totalprice").cast("decimal(18,2)").alias("amount"),
        F.when(status == "P", "uncategorized_outflow").when(cust % 50 == 0, "excluded_duplicate").when(cust % 61 == 0, "unparsed").otherwise("included_spending").alias("treatment"),
        F.when(level == "5-LOW", "other").when(level == "1-URGENT", "shopping").when(level == "2-HIGH", "dining_coffee").otherwise(level).alias("category"),
        F.when((level == "5-LOW") & (F.col("o_orderkey") % 3 == 0), policy.MIXED_NOTE).alias("policy_note"),
    )


def targets(spark: SparkSession) -> DataFrame:
    return spark.sql("SELECT * FROM VALUES ('dining_coffee', CAST(6900000 AS DECIMAL(18,2))), ('shopping', CAST(7100000 AS DECIMAL(18,2))) AS t(category, target)")


def _budgets(spark, sf_dir):
    tx = ledger(spark, sf_dir)
    return totals.budget_comparisons(totals.monthly_category_totals(tx, lines=True), totals.monthly_totals(tx), targets(spark), totals.coverage(tx))


def _deltas(spark, sf_dir):
    tx = ledger(spark, sf_dir)
    return totals.month_deltas(totals.monthly_category_totals(tx, lines=True), totals.monthly_totals(tx))


@query(_W + "SELECT m AS month, category, CAST(amount AS DECIMAL(38,2)) AS amount, array_to_string(lines, ',') AS lines FROM ct")
def monthly_category_totals(spark, sf_dir):
    tx, keys = ledger(spark, sf_dir), ["log_id", "month", "category"]
    rows = totals.monthly_category_totals(tx).drop("lines").join(line_sets.listed(totals.category_lines(tx), keys), keys)
    return rows.select("month", "category", wide("amount"), joined("lines").alias("lines")).orderBy("month", "category")


@query(_W + "SELECT m AS month, CAST(classified AS DECIMAL(38,2)) AS classified, CAST(unresolved AS DECIMAL(38,2)) AS unresolved, CAST(observed AS DECIMAL(38,2)) AS observed, array_to_string(lines, ',') AS lines FROM mt")
def monthly_totals(spark, sf_dir):
    tx, keys = ledger(spark, sf_dir), ["log_id", "month"]
    rows = totals.monthly_totals(tx).drop("lines").join(line_sets.listed(totals.month_lines(tx), keys), keys)
    return rows.select("month", wide("classified"), wide("unresolved"), wide("observed"), joined("lines").alias("lines"))


@query(
    _W
    + """SELECT t.treatment, count(line_number) AS n, coalesce(array_to_string(list_sort(list(line_number) FILTER (line_number IS NOT NULL)), ','), '') AS lines
         FROM (VALUES ('included_spending'), ('excluded_duplicate'), ('uncategorized_outflow'), ('uncategorized_credit'), ('unparsed')) t(treatment) LEFT JOIN tx USING (treatment) GROUP BY t.treatment"""
)
def treatment_partition(spark, sf_dir):
    tx, keys = ledger(spark, sf_dir), ["log_id", "treatment"]
    rows = totals.treatment_partition(tx).drop("lines").join(line_sets.listed(totals.treatment_lines(tx), keys), keys, "left")
    return rows.select("treatment", "n", F.coalesce(joined("lines"), F.lit("")).alias("lines"))


@query(
    _W
    + """, i AS (SELECT treatment, line_number, line_number - row_number() OVER (PARTITION BY treatment ORDER BY line_number) AS island FROM tx),
         r AS (SELECT treatment, min(line_number) AS first, max(line_number) AS last FROM i GROUP BY treatment, island)
         SELECT treatment, first // 4096 AS page, string_agg(CASE WHEN first = last THEN '' || first ELSE first || '-' || last END, ',' ORDER BY first) AS runs FROM r GROUP BY treatment, first // 4096"""
)
def treatment_line_pages(spark, sf_dir):
    """The lines of each treatment as runs, a page for each block of line numbers."""
    keys = ["log_id", "treatment"]
    return line_sets.pages(totals.treatment_lines(ledger(spark, sf_dir)), keys).select("treatment", "page", line_sets.text(F.col("runs")).alias("runs"))


@query(
    _W
    + """, i AS (SELECT m, line_number, line_number - row_number() OVER (PARTITION BY m ORDER BY line_number) AS island FROM tx WHERE treatment IN ('included_spending', 'uncategorized_outflow')),
         r AS (SELECT m, min(line_number) AS first, max(line_number) AS last FROM i GROUP BY m, island) SELECT m AS month, first, last FROM r"""
)
def merged_line_runs(spark, sf_dir):
    """Runs of each month from those of its two treatments."""
    tx = ledger(spark, sf_dir).withColumn("month", totals.month(F.col("occurred_on")))
    parts = [line_sets.runs(totals.with_treatment(tx, t), ["month"]) for t in ("included_spending", "uncategorized_outflow")]
    return line_sets.merged(*parts, ["month"]).select("month", "first", "last")


@query(_W + "SELECT line_number, CAST(amount AS DECIMAL(38,2)) AS amount FROM tx WHERE treatment = 'uncategorized_outflow'")
def treatment_filter(spark, sf_dir):
    return totals.with_treatment(ledger(spark, sf_dir), "uncategorized_outflow").select("line_number", wide("amount"))


@query(
    _W
    + """SELECT count(*) AS n_lines, CAST((SELECT sum(amount) FROM ct) AS DECIMAL(38,2)) AS classified, CAST((SELECT sum(unresolved) FROM mt) AS DECIMAL(38,2)) AS unresolved,
       CAST((SELECT sum(observed) FROM mt) AS DECIMAL(38,2)) AS observed, count(*) FILTER (treatment = 'excluded_duplicate') AS n_duplicates,
       count(*) = count(DISTINCT line_number) AS is_balanced FROM tx"""
)
def reconciliation(spark, sf_dir):
    tx = ledger(spark, sf_dir)
    rows = totals.reconciliation(tx, totals.monthly_category_totals(tx, lines=False), totals.monthly_totals(tx, lines=False), lines=False)
    return rows.select("n_lines", wide("classified"), wide("unresolved"), wide("observed"), "n_duplicates", "is_balanced")


@query(_W + "SELECT m AS month, category, CAST(target AS DECIMAL(38,2)) AS target, CAST(actual AS DECIMAL(38,2)) AS actual, CAST(variance AS DECIMAL(38,2)) AS variance, coalesce(array_to_string(lines, ','), '') AS lines FROM bc")
def budget_comparisons(spark, sf_dir):
    return _budgets(spark, sf_dir).select("month", "category", wide("target"), wide("actual"), wide("variance"), joined("lines").alias("lines"))


@query(_W + f"SELECT m AS month, array_to_string(list_sort(list(line_number)), ',') AS lines FROM tx WHERE treatment = 'included_spending' AND category = 'other' AND policy_note = '{policy.MIXED_NOTE}' GROUP BY m")
def coverage_lines(spark, sf_dir):
    return line_sets.listed(totals.coverage_runs(ledger(spark, sf_dir)), ["log_id", "month"]).select("month", joined("lines").alias("lines"))


@query(_W + "SELECT from_month, to_month, category, CAST(previous AS DECIMAL(38,2)) AS previous, CAST(current AS DECIMAL(38,2)) AS current, CAST(change AS DECIMAL(38,2)) AS change, array_to_string(lines, ',') AS lines FROM de")
def month_category_deltas(spark, sf_dir):
    rows = totals.delta_order(_deltas(spark, sf_dir))
    return rows.select("from_month", "to_month", "category", wide("previous"), wide("current"), wide("change"), joined("lines").alias("lines"))


@query(_W + "SELECT * FROM (SELECT m AS from_month, lead(m) OVER (ORDER BY m) AS to_month, row_number() OVER (ORDER BY m) AS number FROM mt) p WHERE to_month IS NOT NULL")
def adjacent_months(spark, sf_dir):
    return totals.month_pairs(totals.monthly_totals(ledger(spark, sf_dir), lines=False)).select("from_month", "to_month", F.col("number").cast("long").alias("number"))


@query(_W + "SELECT DISTINCT m AS month FROM (SELECT m FROM tx WHERE treatment = 'included_spending' UNION SELECT m FROM tx WHERE treatment = 'uncategorized_outflow') u")
def month_union(spark, sf_dir):
    return totals.monthly_totals(ledger(spark, sf_dir), lines=False).select("month")


@query(_W + "SELECT row_number() OVER (ORDER BY variance DESC, m, category) AS place, m AS month, category, CAST(variance AS DECIMAL(38,2)) AS variance FROM bc WHERE variance > 0")
def ranked_breaches(spark, sf_dir):
    order = Window.partitionBy("log_id").orderBy(F.col("variance").desc(), "month", "category")
    rows = totals.ranked_breaches(_budgets(spark, sf_dir)).withColumn("place", F.row_number().over(order).cast("long"))
    return rows.select("place", "month", "category", wide("variance"))


@query(_W + "SELECT row_number() OVER (ORDER BY abs(change) DESC, to_month, category) AS place, from_month, to_month, category, CAST(change AS DECIMAL(38,2)) AS change FROM de QUALIFY place <= 5")
def top5_changes(spark, sf_dir):
    return totals.top_changes(_deltas(spark, sf_dir), 5).select(F.col("rank").cast("long").alias("place"), "from_month", "to_month", "category", wide("change"))


@query(_W + "SELECT m AS month, category, CAST(variance AS DECIMAL(38,2)) AS variance FROM bc WHERE category = 'dining_coffee' AND variance > 0 ORDER BY variance DESC, m DESC LIMIT 1")
def argmax_breach(spark, sf_dir):
    return totals.largest_breach(_budgets(spark, sf_dir), "dining_coffee").select("month", "category", wide("variance"))


@query(_W + "SELECT from_month, to_month, category, CAST(change AS DECIMAL(38,2)) AS change FROM de ORDER BY abs(change) DESC, to_month, category LIMIT 1")
def argmin_change(spark, sf_dir):
    return totals.largest_change(_deltas(spark, sf_dir)).select("from_month", "to_month", "category", wide("change"))


@query(_W + "SELECT category, CAST(change AS DECIMAL(38,2)) AS change FROM de WHERE from_month = DATE '1997-03-01' AND to_month = DATE '1997-04-01' AND change > 0 ORDER BY change DESC, category LIMIT 1")
def largest_increase(spark, sf_dir):
    import datetime

    return totals.largest_increase(_deltas(spark, sf_dir), datetime.date(1997, 3, 1), datetime.date(1997, 4, 1)).select("category", wide("change"))


_MONEY = "CASE WHEN {0} < 0 THEN '$-' ELSE '$' END || format('{{:,}}', CAST(trunc(abs({0})) AS BIGINT)) || '.' || lpad(CAST(CAST(abs({0}) * 100 AS BIGINT) % 100 AS VARCHAR), 2, '0')"
_NAME = "CASE WHEN {0} = 'dining_coffee' THEN 'Dining & Coffee' WHEN {0} = 'shopping' THEN 'Shopping' ELSE {0} END"


@query(
    _W
    + f"""SELECT 'budget-' || m || '-' || category AS evidence_id, 'In ' || strftime(m, '%B %Y') || ', ' || {_NAME.format("category")} || ' was ' || {_MONEY.format("actual")}
      || ' against a ' || {_MONEY.format("target")} || ' monthly target, ' || {_MONEY.format("abs(variance)")} || ' over target.' AS statement,
      row_number() OVER (ORDER BY variance DESC, m, category) AS place FROM bc WHERE variance > 0"""
)
def budget_statements(spark, sf_dir):
    return findings.budget_evidence(_budgets(spark, sf_dir)).select("evidence_id", "statement", F.col("place").cast("long").alias("place"))


_LABEL = "CASE category WHEN 'dining_coffee' THEN 'Dining & Coffee' WHEN 'shopping' THEN 'Shopping' WHEN 'other' THEN 'Other' WHEN '3-MEDIUM' THEN '3-medium' WHEN '4-NOT SPECIFIED' THEN '4-not Specified' ELSE category END"
_EVIDENCE = (
    _W
    + f""", cov AS (SELECT m, list_sort(list(line_number)) AS lines FROM tx WHERE treatment = 'included_spending' AND category = 'other' AND policy_note = '{policy.MIXED_NOTE}' GROUP BY m
    ), b AS (SELECT 0 AS part, row_number() OVER (ORDER BY variance DESC, m, category) AS place, 'budget-' || m || '-' || category AS evidence_id,
        'In ' || strftime(m, '%B %Y') || ', ' || {_NAME.format("category")} || ' was ' || {_MONEY.format("actual")} || ' against a ' || {_MONEY.format("target")} || ' monthly target, ' || {_MONEY.format("abs(variance)")} || ' over target.' AS statement, len(lines) AS n_lines
      FROM bc WHERE variance > 0
    ), c AS (SELECT 1 AS part, row_number() OVER (ORDER BY abs(change) DESC, to_month, category) AS place, 'change-' || from_month || '-' || to_month || '-' || category AS evidence_id,
        'From ' || strftime(from_month, '%B %Y') || ' to ' || strftime(to_month, '%B %Y') || ', ' || {_LABEL} || CASE WHEN change > 0 THEN ' rose' WHEN change < 0 THEN ' fell' ELSE ' did not change' END
        || ' by ' || {_MONEY.format("abs(change)")} || ', from ' || {_MONEY.format("previous")} || ' to ' || {_MONEY.format("current")} || '.' AS statement, len(lines) AS n_lines
      FROM de QUALIFY place <= 5
    ), s AS (SELECT 2 AS part, 1 AS place, 'shopping-coverage' AS evidence_id,
        'Shopping was below its stated monthly target in ' || count(*) FILTER (variance < 0) || ' of ' || count(*) || ' reported months. These Shopping totals exclude merchant-only mixed-retailer charges assigned to Other, so the comparison does not cover all shopping-like purchases.' AS statement,
        len(list_distinct(flatten(list(list_concat(coalesce(bc.lines, []), coalesce(cov.lines, [])))))) AS n_lines
      FROM bc LEFT JOIN cov USING (m) WHERE category = 'shopping' HAVING count(cov.m) > 0
    ), r AS (SELECT count(*) AS n, count(*) FILTER (treatment = 'excluded_duplicate') AS dup, count(*) FILTER (treatment = 'unparsed') AS lost, count(*) FILTER (treatment = 'included_spending') AS inc,
        count(*) FILTER (treatment = 'uncategorized_outflow') AS open, (SELECT sum(classified) FROM mt) AS classified, (SELECT sum(unresolved) FROM mt) AS unresolved FROM tx
    ), f AS (SELECT 3 AS part, 1 AS place, 'reconciliation-spending' AS evidence_id, 'Classified spending totaled ' || {_MONEY.format("classified")} || ' across the reported period.' AS statement, inc AS n_lines FROM r
      UNION ALL SELECT 3, 2, 'reconciliation-unresolved', 'Unresolved outflows totaled ' || {_MONEY.format("unresolved")} || ' and were kept separate from classified spending.', open FROM r
      UNION ALL SELECT 3, 3, 'reconciliation-coverage', 'The analysis accounted for ' || n || ' source lines, including ' || dup || ' excluded duplicates and ' || lost || ' unparsed lines.', n FROM r
    ), e AS (SELECT *, row_number() OVER (ORDER BY part, place) AS ordinal FROM (SELECT * FROM b UNION ALL SELECT * FROM c UNION ALL SELECT * FROM s UNION ALL SELECT * FROM f) u
    ), q AS (SELECT 'budget-' || m || '-' || category AS evidence_id, 1 AS rank FROM (SELECT * FROM bc WHERE category = 'dining_coffee' AND variance > 0 ORDER BY variance DESC, m DESC LIMIT 1) x
      UNION ALL SELECT 'change-' || from_month || '-' || to_month || '-' || category, 2 FROM (SELECT * FROM de ORDER BY abs(change) DESC, to_month, category LIMIT 1) y UNION ALL SELECT evidence_id, 3 FROM s
    ), """
)


def _evidence(spark, sf_dir):
    tx = ledger(spark, sf_dir)
    ct, mt = totals.monthly_category_totals(tx, lines=True), totals.monthly_totals(tx, lines=True)
    budgets, deltas = totals.budget_comparisons(ct, mt, targets(spark), totals.coverage(tx)), totals.month_deltas(ct, mt)
    rows = findings.evidence(budgets, deltas, totals.reconciliation(tx, ct, mt, lines=True))
    return rows, findings.required_ids(budgets, deltas, tx.select("log_id").distinct())


@query(_EVIDENCE + """z AS (SELECT 1) SELECT ordinal, evidence_id, statement, CAST(n_lines AS INTEGER) AS n_lines FROM e""")
def evidence_statements(spark, sf_dir):
    rows, _ = _evidence(spark, sf_dir)
    return rows.select(F.col("ordinal").cast("long").alias("ordinal"), "evidence_id", "statement", F.size("lines").alias("n_lines"))


@query(
    _EVIDENCE
    + """z AS (SELECT e.*, row_number() OVER (ORDER BY q.rank IS NULL, q.rank, ordinal) AS number FROM e LEFT JOIN q USING (evidence_id))
      SELECT CAST(number AS INTEGER) AS number, evidence_id, statement, CAST(n_lines AS INTEGER) AS n_lines FROM z WHERE number <= 3"""
)
def evidence_and_findings(spark, sf_dir):
    rows, required = _evidence(spark, sf_dir)
    chosen = findings.findings(findings.default_selection(rows, required), rows)
    return chosen.select("number", "evidence_id", "statement", F.size("lines").alias("n_lines"))


@query(_W + "SELECT count(*) FILTER (variance < 0) AS under, count(*) AS months FROM bc WHERE category = 'shopping'")
def months_under_target(spark, sf_dir):
    return findings.months_under(_budgets(spark, sf_dir)).drop("log_id")


@query(
    """WITH w AS (SELECT o_custkey, o_orderkey, lag(o_orderstatus || o_orderpriority) OVER c = o_orderstatus || o_orderpriority AS dup FROM orders WINDOW c AS (PARTITION BY o_custkey ORDER BY o_orderkey)),
       r AS (SELECT *, last_value(CASE WHEN NOT coalesce(dup, false) THEN o_orderkey END IGNORE NULLS) OVER (PARTITION BY o_custkey ORDER BY o_orderkey ROWS UNBOUNDED PRECEDING) AS origin FROM w)
       SELECT o_custkey, o_orderkey, origin AS duplicate_of FROM r WHERE dup"""
)
def adjacent_duplicates(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_orderstatus", "o_orderpriority")
    rows = reconcile.adjacent_duplicates(rows, "o_custkey", "o_orderkey", ["o_orderstatus", "o_orderpriority"], step=False)
    return rows.filter("is_duplicate").select("o_custkey", "o_orderkey", "duplicate_of")


@query(
    """WITH w AS (SELECT o_orderkey, coalesce(lag(o_orderstatus) OVER c = o_orderstatus AND lag(o_orderkey) OVER c = o_orderkey - 1, false) AS dup FROM orders WINDOW c AS (ORDER BY o_orderkey))
       SELECT o_orderkey, max(CASE WHEN NOT dup THEN o_orderkey END) OVER (ORDER BY o_orderkey ROWS UNBOUNDED PRECEDING) AS origin, dup AS is_duplicate FROM w"""
)
def duplicates_in_one_log(spark, sf_dir):
    """All orders are one log, which is gone through block by block."""
    rows = table(spark, sf_dir, "orders").select(F.lit("orders").alias("log_id"), "o_orderkey", "o_orderstatus")
    rows = reconcile.adjacent_duplicates(rows, "log_id", "o_orderkey", ["o_orderstatus"])
    return rows.select("o_orderkey", F.coalesce("duplicate_of", "o_orderkey").alias("origin"), "is_duplicate")


# --- text lines ---------------------------------------------------------------------------------------------------


def rendered(spark, sf_dir) -> DataFrame:
    """Orders written as text lines: date, priority and amount."""
    text = F.concat_ws(" | ", F.date_format("o_orderdate", "yyyy-MM-dd"), "o_orderpriority", fm.money(F.col("o_totalprice").cast("decimal(18,2)")))
    return table(spark, sf_dir, "orders").select((F.col("o_custkey") % 100).cast("string").alias("log_id"), F.col("o_orderkey").alias("line_number"), text.alias("source_text"))


@query("SELECT o_orderkey AS line_number, CAST(o_orderdate AS DATE) AS occurred_on, o_orderpriority AS description, CAST(o_totalprice AS DECIMAL(18,2)) AS amount, 0 AS n_issues FROM orders")
def parse_rendered_log(spark, sf_dir):
    return parsing.parse(rendered(spark, sf_dir)).select("line_number", "occurred_on", "description", "amount", F.size("issues").alias("n_issues"))


@query("SELECT o_orderkey AS line_number, 'multiple_dates,missing_amount' AS issues FROM orders WHERE o_orderkey % 5 = 0")
def uncertain_lines(spark, sf_dir):
    rows = rendered(spark, sf_dir)
    two = F.concat(F.lit("2024-01-02 and 2024-01-03 "), F.col("line_number").cast("string"), F.lit(" shop"))
    rows = rows.withColumn("source_text", F.when(F.col("line_number") % 5 == 0, two).otherwise(F.col("source_text")))
    return parsing.uncertain(parsing.parse(rows)).select("line_number", F.array_join("issues", ",").alias("issues"))


@query(
    """WITH o AS (SELECT o_orderkey AS k, format('{:,.2f}', CAST(o_totalprice AS DECIMAL(18,2))::DOUBLE) AS t, CAST(o_totalprice AS DECIMAL(18,2)) AS v FROM orders)
       SELECT k AS line_number, 0 AS place, '$' || t AS amount_text, v AS amount FROM o WHERE k % 4 = 0 UNION ALL SELECT k, 0, '( ' || t || ' )', CAST(-v AS DECIMAL(18,2)) FROM o WHERE k % 4 = 1
       UNION ALL SELECT k, 0, '-$' || t, CAST(-v AS DECIMAL(18,2)) FROM o WHERE k % 4 = 2 UNION ALL SELECT k, 1, '$-7.25', CAST(-7.25 AS DECIMAL(18,2)) FROM o WHERE k % 4 = 2"""
)
def amount_extraction(spark, sf_dir):
    """All written forms of an amount, and lines that only look like having one."""
    k, t = F.col("o_orderkey"), F.format_number(F.col("o_totalprice").cast("decimal(18,2)"), 2)
    text = (
        F.when(k % 4 == 0, F.concat(F.lit("2024-01-02 shop $"), t, F.lit(", thanks")))
        .when(k % 4 == 1, F.concat(F.lit("credit ( "), t, F.lit(" ) posted")))
        .when(k % 4 == 2, F.concat(F.lit("moved -$"), t, F.lit(" and $-7.25 back")))
        .otherwise(F.concat(F.lit("part 12.345 of x1.50, 1.2.34 and $12.3 no "), k.cast("string")))
    )
    rows = table(spark, sf_dir, "orders").select(k.alias("line_number"), text.alias("t"))
    return rows.select("line_number", F.posexplode(ev.amount_candidates(F.col("t"))).alias("place", "amount_text")).withColumn("amount", ev.parse_amount(F.col("amount_text")))


@query(
    """WITH o AS (SELECT o_orderkey AS k, CAST(o_orderdate AS DATE) AS d FROM orders)
       SELECT k AS line_number, 0 AS place, strftime(d, '%Y-%m-%d') AS date_text, d AS day FROM o WHERE k % 4 = 0 UNION ALL SELECT k, 0, strftime(d, '%B %-d, %Y'), d FROM o WHERE k % 4 = 1
       UNION ALL SELECT k, 0, strftime(d, '%b. %d'), CAST('2020' || strftime(d, '-%m-%d') AS DATE) FROM o WHERE k % 4 = 2 UNION ALL SELECT k, 1, strftime(d, '%-m/%-d/%Y'), d FROM o WHERE k % 4 = 2"""
)
def date_extraction(spark, sf_dir):
    """All three written forms of a date, and lines that only look like having one."""
    k, d = F.col("o_orderkey"), F.col("o_orderdate").cast("date")
    text = (
        F.when(k % 4 == 0, F.concat(F.lit("paid "), F.date_format(d, "yyyy-MM-dd"), F.lit(" cafe 5.00")))
        .when(k % 4 == 1, F.concat(F.date_format(d, "MMMM d, yyyy"), F.lit(" shop")))
        .when(k % 4 == 2, F.concat(F.lit("bought "), F.date_format(d, "MMM. dd"), F.lit(", posted "), F.date_format(d, "M/d/yyyy")))
        .otherwise(F.concat(F.lit("id x"), F.date_format(d, "yyyy-MM-dd"), F.lit(" ref 1/2/3/4 release 1.2-3 Marchand 5 no "), k.cast("string")))
    )
    rows = table(spark, sf_dir, "orders").select(k.alias("line_number"), text.alias("t"))
    found = rows.select("line_number", F.posexplode(ev.date_candidates(F.col("t"))).alias("place", "date_text"))
    return found.withColumn("day", ev.parse_date_evidence(F.col("date_text"), F.lit(2020)))


@query("SELECT event_id, 'refund' AS side, CAST(-round(abs(value), 2) AS DECIMAL(18,2)) AS amount FROM events WHERE round(abs(value), 2) > 0 UNION ALL SELECT event_id, 'plain' AS side, CAST(round(abs(value), 2) AS DECIMAL(18,2)) AS amount FROM events WHERE round(abs(value), 2) > 0")
def refund_sign(spark, sf_dir):
    value = F.round(F.abs("value"), 2).cast("decimal(18,2)")
    rows = table(spark, sf_dir, "events").select("event_id", value.alias("v")).filter("v > 0")
    texts = F.array(F.struct(F.lit("refund").alias("side"), F.concat(F.lit("Cafe refund "), fm.money(F.col("v"))).alias("t")), F.struct(F.lit("plain").alias("side"), F.concat(F.lit("no refund Cafe "), fm.money(F.col("v"))).alias("t")))
    rows = rows.select("event_id", F.inline(texts))
    first = ev.parse_amount(F.element_at(ev.amount_candidates(F.col("t")), 1))
    return rows.select("event_id", "side", ev.refund_adjusted(first, ev.amount_context(F.col("t"), 0)).alias("amount"))


@query("SELECT c_custkey FROM customer WHERE c_acctbal < 0")
def refund_lines(spark, sf_dir):
    rows = table(spark, sf_dir, "customer")
    ledger = rows.select(
        F.col("c_nationkey").alias("log_id"),
        F.col("c_custkey").alias("line_number"),
        F.lit("2024-01-01").cast("date").alias("occurred_on"),
        F.col("c_acctbal").cast("decimal(18,2)").alias("amount"),
        F.lit("included_spending").alias("treatment"),
        F.col("c_mktsegment").alias("category"),
    )
    checked = totals.reconciliation(ledger, totals.monthly_category_totals(ledger), totals.monthly_totals(ledger), lines=True)
    return checked.select(F.explode("refunds").alias("c_custkey"))


@query(
    """WITH e AS (SELECT user_id, month(ts) + CASE WHEN event_id % 97 = 0 THEN 7 ELSE 0 END AS mo, CASE WHEN event_id % 3 = 0 THEN 2024 END AS y, event_id FROM events),
       l AS (SELECT *, lag(mo) OVER w AS pm, lag(y) OVER w AS py FROM e WINDOW w AS (PARTITION BY user_id ORDER BY event_id))
       SELECT user_id, CASE WHEN min(y) = max(y) AND NOT bool_or(coalesce(abs(mo - pm) >= 6 AND NOT coalesce(y = py, false), false)) THEN min(y) END AS inferred_year FROM l GROUP BY user_id"""
)
def period_inference(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    month = F.month("ts") + F.when(F.col("event_id") % 97 == 0, 7).otherwise(0)
    rows = e.select(F.col("user_id").alias("log_id"), F.col("event_id").alias("line_number"), month.alias("month"), F.when(F.col("event_id") % 3 == 0, 2024).alias("year"))
    return parsing.infer_years(rows).select(F.col("log_id").alias("user_id"), "inferred_year")


@query(
    """WITH e AS (SELECT event_id % 3 = 1 AS late, event_id, CASE WHEN event_id % 3 = 1 AND event_id >= 5000 THEN 11 ELSE month(ts) END AS mo, CASE WHEN event_id % 7 = 0 THEN 2024 END AS y FROM events),
       l AS (SELECT *, lag(mo) OVER w AS pm, lag(y) OVER w AS py FROM e WINDOW w AS (PARTITION BY late ORDER BY event_id))
       SELECT late, CASE WHEN min(y) = max(y) AND NOT bool_or(coalesce(abs(mo - pm) >= 6 AND NOT coalesce(y = py, false), false)) THEN min(y) END AS inferred_year FROM l GROUP BY late"""
)
def period_of_long_logs(spark, sf_dir):
    """All events as two long logs, each of many blocks; the months of one leap over the turn of a year."""
    e = table(spark, sf_dir, "events")
    late = F.col("event_id") % 3 == 1
    month = F.when(late & (F.col("event_id") >= 5000), 11).otherwise(F.month("ts"))
    rows = e.select(late.alias("log_id"), F.col("event_id").alias("line_number"), month.alias("month"), F.when(F.col("event_id") % 7 == 0, 2024).alias("year"))
    return parsing.infer_years(rows).select(F.col("log_id").alias("late"), "inferred_year")


@query(
    f"""SELECT p_partkey, CASE WHEN p_size % 7 = 0 THEN 'uncategorized' WHEN p_brand = 'Brand#11' THEN 'shopping' WHEN p_brand IN ('Brand#12', 'Brand#13') THEN 'other' ELSE lower(p_type) END AS category,
       CASE WHEN p_size % 7 = 0 THEN '{policy.CASH_NOTE}' WHEN p_brand = 'Brand#11' THEN '{policy.KNOWN_NOTE}Brand#11' WHEN p_brand IN ('Brand#12', 'Brand#13') THEN '{policy.MIXED_NOTE}' END AS policy_note FROM part"""
)
def policy_category(spark, sf_dir):
    name = F.when(F.col("p_size") % 7 == 0, F.concat(F.lit("ATM  withdrawal "), "p_brand")).otherwise(F.upper("p_brand"))
    rows = table(spark, sf_dir, "part").select("p_partkey", name.alias("description"), F.lower("p_type").alias("model_category"))
    known = spark.createDataFrame([("brand#11", "Brand#11", "shopping")], "merchant_key string, merchant string, merchant_category string")
    return policy.apply_policy(rows, known=known, mixed=("Brand#12", "Brand#13")).select("p_partkey", "category", "policy_note")


@query("SELECT c_custkey, CASE WHEN c_custkey % 10 = 0 THEN 'NEW' ELSE c_mktsegment END AS c_mktsegment, CASE WHEN c_custkey % 10 = 0 THEN 0.0 ELSE c_acctbal END AS c_acctbal FROM customer")
def replace_by_key(spark, sf_dir):
    rows = table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment", "c_acctbal")
    patch = rows.filter("c_custkey % 10 = 0").select("c_custkey", F.lit("NEW").alias("c_mktsegment"), F.lit(0.0).alias("c_acctbal"))
    return parsing.replace_by_key(rows, patch, ["c_custkey"])


_SECRET_SQL = """coalesce(text, '') || ' a OPENAI_API_KEY="' || h || '" b sk-proj-' || h || ' c github_pat_' || h || ' d ghp_' || h || ' e Bearer ' || h"""
for _pattern in fm.SECRETS:
    _SECRET_SQL = f"regexp_replace({_SECRET_SQL}, '{_pattern.replace(chr(39), chr(39) * 2)}', '{fm.REDACTED}', 'g')"


@query(f"SELECT doc_id, {_SECRET_SQL} AS checked FROM (SELECT doc_id, text, sha256(CAST(doc_id AS VARCHAR)) AS h FROM documents) d")
def redaction(spark, sf_dir):
    """Every whole text, with all five shapes of secrets added to it."""
    h = F.sha2(F.col("doc_id").cast("string"), 256)
    text = F.concat(F.coalesce("text", F.lit("")), F.lit(' a OPENAI_API_KEY="'), h, F.lit('" b sk-proj-'), h, F.lit(" c github_pat_"), h, F.lit(" d ghp_"), h, F.lit(" e Bearer "), h)
    return table(spark, sf_dir, "documents").select("doc_id", fm.redact(text).alias("checked"))


@query("SELECT doc_id, length(text) AS n FROM documents WHERE regexp_matches(text, '(?i)\\bBearer\\s+[A-Za-z0-9._~+/-]{12,}|\\bsk-(?:or-v1-|proj-)?[A-Za-z0-9_-]{12,}\\b|\\bgithub_pat_[A-Za-z0-9_]{12,}\\b')")
def texts_with_secrets(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return docs.filter(~F.col("text").eqNullSafe(fm.redact(F.col("text")))).select("doc_id", F.length("text").cast("long").alias("n"))


@query("SELECT l_returnflag, l_linestatus, strftime(min(l_shipdate), '%Y-%m') AS first_period, strftime(max(l_shipdate), '%B %Y') AS last_month FROM lineitem GROUP BY ALL")
def month_formats(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").groupBy("l_returnflag", "l_linestatus").agg(F.min("l_shipdate").alias("a"), F.max("l_shipdate").alias("b"))
    return rows.select("l_returnflag", "l_linestatus", fm.period(F.col("a")).alias("first_period"), fm.month_name(F.col("b")).alias("last_month"))


# --- conversations ------------------------------------------------------------------------------------------------

_TURNS = "t AS (SELECT conv_id, turn, role, text, length(text) AS n FROM conversations)"


def _turns(spark, sf_dir):
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")


def _calls_and_outputs(spark, sf_dir):
    """Every call has a key of its own, its number in the conversation; outputs have that of the last call before them."""
    so_far = Window.partitionBy("conv_id").orderBy("turn").rowsBetween(Window.unboundedPreceding, 0)
    turns = _turns(spark, sf_dir).select("conv_id", "turn", "role", F.count_if(F.col("role") == "user").over(so_far).alias("call_number"))
    calls = turns.filter("role = 'user'").select("conv_id", "call_number", F.col("turn").alias("call_turn"))
    return calls, turns.filter("role = 'assistant'").select("conv_id", "call_number", F.col("turn").alias("output_turn"))


@query(
    """WITH c AS (SELECT conv_id, min(turn) AS call_turn FROM conversations WHERE role = 'user' GROUP BY conv_id)
       SELECT c.conv_id, call_turn, min(turn) AS output_turn FROM c JOIN conversations a ON a.conv_id = c.conv_id AND a.role = 'assistant' AND a.turn > call_turn GROUP BY ALL"""
)
def call_output_pairing(spark, sf_dir):
    calls, outputs = _calls_and_outputs(spark, sf_dir)
    outputs = outputs.drop("call_number")
    first = calls.groupBy("conv_id").agg(F.min("call_turn").alias("call_turn"))
    return rollout.call_output_pairs(first, outputs, ["conv_id"], "call_turn", "output_turn").select("conv_id", "call_turn", "output_turn")


@query(
    """WITH n AS (SELECT conv_id, turn, role, count(*) FILTER (role = 'user') OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING) AS call_number FROM conversations)
       SELECT c.conv_id, c.call_number, c.turn AS call_turn, min(a.turn) AS output_turn FROM n c JOIN n a ON a.conv_id = c.conv_id AND a.call_number = c.call_number AND a.role = 'assistant'
       WHERE c.role = 'user' AND a.turn > c.turn GROUP BY ALL"""
)
def call_output_pairing_all(spark, sf_dir):
    calls, outputs = _calls_and_outputs(spark, sf_dir)
    return rollout.call_output_pairs(calls, outputs, ["conv_id", "call_number"], "call_turn", "output_turn").select("conv_id", "call_number", "call_turn", "output_turn")


@query(
    """WITH n AS (SELECT conv_id, turn, role, count(*) FILTER (role = 'user') OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING) AS call_number FROM conversations)
       SELECT conv_id, call_number, turn AS call_turn FROM n u WHERE role = 'user' AND NOT EXISTS (SELECT 1 FROM n a WHERE a.conv_id = u.conv_id AND a.call_number = u.call_number AND a.role = 'assistant')"""
)
def unmatched_calls(spark, sf_dir):
    calls, outputs = _calls_and_outputs(spark, sf_dir)
    key = ["conv_id", "call_number"]
    return rollout.unmatched_calls(calls, rollout.call_output_pairs(calls, outputs, key, "call_turn", "output_turn"), key)


_KEPT = "k AS (SELECT *, role <> 'assistant' OR row_number() OVER (PARTITION BY conv_id, role = 'assistant' ORDER BY turn DESC) <= 2 AS kept FROM t)"


@query(f"WITH {_TURNS}, {_KEPT} SELECT conv_id, turn, kept FROM k")
def recency_baseline(spark, sf_dir):
    return compaction.recency_selection(_turns(spark, sf_dir), 2, "conv_id", "turn", F.col("role") == "assistant").select("conv_id", "turn", "kept")


@query(
    f"""WITH {_TURNS}, {_KEPT}, s AS (SELECT conv_id, sum(n) AS original, coalesce(sum(n) FILTER (kept), 0) AS retained FROM k GROUP BY conv_id),
        q AS (SELECT *, (original - retained) * 1000 // original AS low, (original - retained) * 1000 % original * 2 AS twice FROM s WHERE original > 0)
        SELECT conv_id, CAST(original AS BIGINT) AS original, CAST(retained AS BIGINT) AS retained,
               CAST(low + CASE WHEN twice > original OR (twice = original AND low % 2 = 1) THEN 1 ELSE 0 END AS DOUBLE) / 10 AS reduction_percent FROM q"""
)
def reduction_percent(spark, sf_dir):
    rows = compaction.recency_selection(_turns(spark, sf_dir), 2, "conv_id", "turn", F.col("role") == "assistant")
    out = compaction.sizes(rows.withColumnRenamed("conv_id", "trial_id"), F.length("text").cast("long"))
    exact = fm.reduction_percent(F.col("original"), F.col("retained")).cast("double")
    return out.filter("original > 0").select(F.col("trial_id").alias("conv_id"), "original", "retained", exact.alias("reduction_percent"))


@query("SELECT conv_id, turn, role <> 'assistant' OR (conv_id * 7 + turn * 13) % 100 >= 50 AS kept FROM conversations")
def retention_selection(spark, sf_dir):
    turns = _turns(spark, sf_dir)
    rows = turns.select(F.col("conv_id").alias("trial_id"), F.col("turn").alias("position"), F.col("turn").cast("string").alias("id"), F.when(F.col("role") == "assistant", "tool").otherwise(F.col("role")).alias("kind"), "text")
    decided = rows.filter("kind = 'tool'").select("trial_id", "id", (((F.col("trial_id") * 7 + F.col("position") * 13) % 100) / 100).alias("probability")).distinct()
    return compaction.select_segments(rows, decided).select(F.col("trial_id").alias("conv_id"), F.col("position").alias("turn"), "kept")


@query(f"WITH {_TURNS} SELECT conv_id, min(turn) AS turn, arg_min(text, turn) AS answer FROM t WHERE role = 'assistant' AND turn >= 2 AND text <> '' GROUP BY conv_id")
def first_after_cutoff(spark, sf_dir):
    rows = _turns(spark, sf_dir).select(F.col("conv_id").alias("trial_id"), F.col("turn").alias("line_number"), F.lit("message").alias("type"), "role", "text")
    trials = rows.select("trial_id").distinct().select("trial_id", F.lit(0).cast("long").alias("start_line"), F.lit(2).cast("long").alias("cutoff_line"))
    found = rollout.held_out_answers(rows, trials)
    return found.select(F.col("trial_id").alias("conv_id"), F.col("answer_line").alias("turn"), "answer")


@query(f"WITH {_TURNS} SELECT conv_id, count(*) FILTER (role <> 'assistant') AS messages, CAST(sum(n) FILTER (role = 'assistant') AS BIGINT) AS tool_characters FROM t GROUP BY conv_id")
def segment_summary(spark, sf_dir):
    turns = _turns(spark, sf_dir)
    rows = turns.select(F.col("conv_id").alias("trial_id"), F.col("turn").cast("string").alias("id"), F.when(F.col("role") == "assistant", "tool").otherwise(F.col("role")).alias("kind"), "text", F.lit(None).cast("string").alias("result"))
    sizes = F.map_values("tool_characters")
    total = F.when(F.size(sizes) > 0, F.aggregate(sizes, F.lit(0).cast("long"), lambda a, n: a + n))
    return compaction.describe(rows).select(F.col("trial_id").alias("conv_id"), "messages", total.alias("tool_characters"))


# --- grading ------------------------------------------------------------------------------------------------------


def _perturbed(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("line_number"), F.col("o_totalprice").cast("decimal(18,2)").alias("amount"), F.col("o_orderpriority").alias("category"))
    k = F.col("line_number")
    made = o.filter(k % 41 != 0).select(k, F.when(k % 29 == 0, F.col("amount") + 1).otherwise(F.col("amount")).cast("decimal(18,2)").alias("amount"), F.when(k % 31 == 0, "other").otherwise(F.col("category")).alias("category"))
    return o.filter(k % 43 != 0), made


@query(
    """SELECT o_orderkey AS line_number, concat_ws(',', CASE WHEN o_orderkey % 41 = 0 THEN 'missing' END, CASE WHEN o_orderkey % 43 = 0 THEN 'extra' END,
       CASE WHEN o_orderkey % 41 <> 0 AND o_orderkey % 43 <> 0 AND o_orderkey % 29 = 0 THEN 'amount' END,
       CASE WHEN o_orderkey % 41 <> 0 AND o_orderkey % 43 <> 0 AND o_orderkey % 31 = 0 THEN 'category' END) AS differences
       FROM orders WHERE NOT (o_orderkey % 41 = 0 AND o_orderkey % 43 = 0) AND (o_orderkey % 41 = 0 OR o_orderkey % 43 = 0 OR o_orderkey % 29 = 0 OR o_orderkey % 31 = 0)"""
)
def ledger_diff(spark, sf_dir):
    reference, made = _perturbed(spark, sf_dir)
    return grading.ledger_diff(reference, made, ["line_number"], ["amount", "category"]).select("line_number", F.array_join("differences", ",").alias("differences"))


@query(
    """SELECT o_orderkey AS line_number, CASE WHEN o_orderkey % 41 = 0 THEN 'missing' WHEN o_orderkey % 43 = 0 THEN 'extra' ELSE 'misread' END AS kind,
       CAST(CASE WHEN o_orderkey % 41 = 0 THEN -CAST(o_totalprice AS DECIMAL(18,2)) WHEN o_orderkey % 43 = 0 THEN CAST(o_totalprice AS DECIMAL(18,2)) + CASE WHEN o_orderkey % 29 = 0 THEN 1 ELSE 0 END ELSE 1 END AS DECIMAL(18,2)) AS effect
       FROM orders WHERE NOT (o_orderkey % 41 = 0 AND o_orderkey % 43 = 0) AND (o_orderkey % 41 = 0 OR o_orderkey % 43 = 0 OR o_orderkey % 29 = 0)"""
)
def bucket_difference(spark, sf_dir):
    reference, made = _perturbed(spark, sf_dir)
    members = reference.select("line_number", "amount", F.lit("all").alias("category"), F.lit("all").alias("period"), F.lit(True).alias("is_counted"), F.lit(None).cast("string").alias("policy_name"), F.lit(None).cast("array<string>").alias("alternatives"))
    return policies.separable_differences(members, made, made, "all", "all").select("line_number", "kind", "effect")


@query(
    """SELECT event_type AS check_name, count(*) AS runs, count(*) FILTER (value > 20) AS passed, count(*) FILTER (value <= 5) AS errored,
       CAST(floor(round(count(*) FILTER (value > 20) / count(*) * 100, 6)) AS BIGINT) || '%' AS pass_rate FROM events GROUP BY event_type"""
)
def pass_rate(spark, sf_dir):
    grades = table(spark, sf_dir, "events").select(F.col("event_type").alias("check_name"), F.when(F.col("value") > 20, "passed").when(F.col("value") <= 5, "errored").otherwise("failed").alias("status"))
    minimum = grades.select("check_name").distinct().withColumn("minimum_pass_rate", F.lit(1.0))
    return grading.scorecard(grades, minimum).select("check_name", "runs", "passed", "errored", fm.pass_rate_text(F.col("pass_rate")).alias("pass_rate"))


@query("SELECT event_type, median(value) FILTER (event_id % 10 <> 0) AS median, min(value) FILTER (event_id % 10 <> 0) AS minimum, max(value) FILTER (event_id % 10 <> 0) AS maximum, count(value) FILTER (event_id % 10 <> 0) AS n FROM events GROUP BY event_type")
def timing_summary(spark, sf_dir):
    return grading.timing_summary(table(spark, sf_dir, "events"), ["event_type"], "value", F.col("event_id") % 10 != 0)


@query("SELECT l_returnflag, median(l_extendedprice) AS median, median(l_quantity) AS quantity FROM lineitem GROUP BY l_returnflag")
def medians_of_large_groups(spark, sf_dir):
    """Prices, almost all different, and quantities, of which there are fifty: groups of a third of all rows are narrowed down."""
    rows = table(spark, sf_dir, "lineitem").select("l_returnflag", "l_extendedprice", "l_quantity")
    prices = selection.medians(rows, ["l_returnflag"], F.col("l_extendedprice"), few=1000)
    return prices.join(selection.medians(rows, ["l_returnflag"], F.col("l_quantity"), few=1000).withColumnRenamed("median", "quantity"), "l_returnflag")


@query(
    """SELECT event_id, CASE WHEN s < 10 THEN printf('%.1fs', CAST(s AS DOUBLE)) WHEN s < 60 THEN s || 's' WHEN s < 3600 THEN (s // 60) || 'm ' || lpad(CAST(s % 60 AS VARCHAR), 2, '0') || 's'
       ELSE (s // 3600) || 'h ' || lpad(CAST(s % 3600 // 60 AS VARCHAR), 2, '0') || 'm' END AS duration FROM (SELECT event_id, event_id * 7 % 9000 AS s FROM events) e"""
)
def duration_texts(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", fm.duration_text((F.col("event_id") * 7 % 9000).cast("double")).alias("duration"))


@query("SELECT event_id, printf('%.1fs', (event_id * 7 % 199) / 20) AS duration FROM events")
def durations_in_tenths(spark, sf_dir):
    """Twentieths of a second up to 9.9: half of them lie between two tenths, as nearly as a double holds them."""
    return table(spark, sf_dir, "events").select("event_id", fm.duration_text((F.col("event_id") * 7 % 199) / 20).alias("duration"))


@query("SELECT user_id, event_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS n FROM events) e WHERE n = 1")
def latest_per_key(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select("user_id", "event_id", "event_type", "ts")
    return grading.latest_per_key(rows, ["user_id"], [F.col("ts").desc(), F.col("event_id").desc()]).select("user_id", "event_id", "event_type")


@query(
    """SELECT k, 'missing' AS side FROM (SELECT p_partkey AS k FROM part EXCEPT SELECT l_partkey FROM lineitem WHERE l_quantity > 45) a
       UNION ALL SELECT k, 'invented' AS side FROM (SELECT l_partkey AS k FROM lineitem WHERE l_quantity > 45 EXCEPT SELECT p_partkey FROM part WHERE p_partkey % 9 <> 0) b"""
)
def set_difference(spark, sf_dir):
    parts, used = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("k")), table(spark, sf_dir, "lineitem").filter("l_quantity > 45").select(F.col("l_partkey").alias("k"))
    missing = grading.set_differences(used, parts).filter("side = 'missing'")
    return missing.unionByName(grading.set_differences(used, parts.filter("k % 9 <> 0")).filter("side = 'invented'"))


@query(
    """WITH r AS (SELECT r_regionkey AS k, r_name AS n FROM region), m AS (SELECT range AS mask FROM range(0, 32))
       SELECT coalesce(string_agg(n, ',' ORDER BY k) FILTER ((mask >> k) & 1 = 1), '') AS applied, CAST(bit_count(CAST(mask AS INTEGER)) AS INTEGER) AS size FROM m CROSS JOIN r GROUP BY mask"""
)
def policy_power_set(spark, sf_dir):
    regions = table(spark, sf_dir, "region").select(F.lit("all").alias("g"), F.col("r_name").alias("name"), F.col("r_regionkey").alias("place"))
    return grading.policy_subsets(regions, ["g"]).select(F.array_join("applied", ",").alias("applied"), F.size("applied").alias("size"))


@query("SELECT c_nationkey, count(*) AS n FROM customer GROUP BY c_nationkey HAVING count(*) > 1")
def frequency_counts(spark, sf_dir):
    return grading.frequent(table(spark, sf_dir, "customer"), ["c_nationkey"])


@query("SELECT c_custkey, abs(CAST(c_acctbal AS DECIMAL(18,2)) - 500.00) <= 250.01 OR abs(CAST(c_acctbal AS DECIMAL(18,2)) + 100) <= 250.01 AS accepted FROM customer")
def tolerance(spark, sf_dir):
    expected = F.array(F.lit("500.00").cast("decimal(18,2)"), F.lit("-100").cast("decimal(18,2)"))
    return table(spark, sf_dir, "customer").select("c_custkey", fm.within_tolerance(F.col("c_acctbal").cast("decimal(18,2)"), expected, "250.01").alias("accepted"))


@query("SELECT event_id, event_type, user_id, n AS run FROM events CROSS JOIN (VALUES (1), (2), (3)) r(n)")
def repeated_trials_all(spark, sf_dir):
    return grading.repeated_trials(table(spark, sf_dir, "events").select("event_id", "event_type", "user_id"), 3)


_LINES = """l AS (SELECT event_id % 10 AS run, event_id AS line_number, CASE WHEN event_id % 7 = 0 THEN 'uncategorized_outflow' WHEN event_id % 11 = 0 THEN 'excluded_duplicate' ELSE 'included_spending' END AS treatment,
  CAST(value AS DECIMAL(18,2)) AS amount, event_type AS category FROM events)"""


def _graded_lines(spark, sf_dir):
    k = F.col("event_id")
    kind = F.when(k % 7 == 0, "uncategorized_outflow").when(k % 11 == 0, "excluded_duplicate").otherwise("included_spending")
    return table(spark, sf_dir, "events").select((k % 10).alias("run"), k.alias("line_number"), kind.alias("treatment"), F.col("value").cast("decimal(18,2)").alias("amount"), F.col("event_type").alias("category"))


@query(
    f"""WITH {_LINES} SELECT line_number, 'elsewhere' AS kind FROM l WHERE treatment = 'included_spending' AND category = 'click' AND line_number % 13 = 0
        UNION ALL SELECT line_number, 'wrongly here' AS kind FROM l WHERE (treatment <> 'excluded_duplicate' AND category <> 'click' AND line_number % 13 = 0)
        OR (treatment = 'uncategorized_outflow' AND category = 'click' AND line_number % 13 <> 0)"""
)
def category_difference(spark, sf_dir):
    lines = _graded_lines(spark, sf_dir)
    reference = lines.select("line_number", "category", (F.col("treatment") == "included_spending").alias("is_counted"), F.lit(None).cast("array<string>").alias("alternatives"))
    swapped = F.when(F.col("line_number") % 13 == 0, F.when(F.col("category") == "click", "view").otherwise("click")).otherwise(F.col("category"))
    return grading.category_differences(reference, lines.withColumn("category", swapped), "click")


from . import decision_queries, grading_queries, source_queries, text_queries  # noqa: E402,F401  (they register their queries)
