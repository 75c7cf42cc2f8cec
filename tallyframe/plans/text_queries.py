"""Registered queries of line evidence, treatments and the report."""

from __future__ import annotations

from types import SimpleNamespace

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import evidence as ev
from ..functions import formatting as fm
from ..operators import findings, parsing, policy, reconcile, report, totals
from .registry import _LABEL, _W, ledger, query, rendered, table, targets


def _orders(spark, sf_dir):
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("line_number"), fm.money(F.col("o_totalprice").cast("decimal(18,2)")).alias("money"))


@query(
    """SELECT o_orderkey AS line_number, CASE WHEN o_orderkey % 3 = 2 THEN CAST(o_totalprice AS DECIMAL(18,2)) END AS amount,
       CASE WHEN o_orderkey % 3 < 2 THEN 'nontransaction_amount' ELSE '' END AS issues FROM orders"""
)
def balance_amounts(spark, sf_dir):
    k = F.col("line_number")
    lead = F.when(k % 3 == 0, "2024-01-02 card Balance of: ").when(k % 3 == 1, "2024-01-02 card balance ").otherwise("2024-01-02 balance sheet paper ")
    rows = _orders(spark, sf_dir).select((k % 100).cast("string").alias("log_id"), k, F.concat(lead, F.col("money")).alias("source_text"))
    return parsing.parse(rows).select("line_number", "amount", F.array_join("issues", ",").alias("issues"))


@query("SELECT o_orderkey AS line_number, o_orderkey % 3 <> 0 AS descriptive FROM orders")
def descriptive_texts(spark, sf_dir):
    k = F.col("line_number")
    text = F.when(k % 3 == 0, F.concat(F.lit("March 5, 2024 | "), F.col("money"), F.lit(" (12)"))).when(k % 3 == 1, F.concat(F.lit("March 5, 2024 | "), F.col("money"), F.lit(" é"))).otherwise(F.lit("Marchand 5"))
    return _orders(spark, sf_dir).select("line_number", ev.has_descriptive_text(text).alias("descriptive"))


@query("SELECT o_orderkey AS line_number, o_orderkey % 2 = 0 AS found, o_orderkey % 3 = 0 AS is_balance FROM orders")
def evidence_matches(spark, sf_dir):
    k, money = F.col("line_number"), F.col("money")
    text = F.concat(F.lit("paid "), F.when(k % 2 == 0, money).otherwise(F.lit("$0.00")), F.when(k % 3 == 0, F.concat(F.lit(", new balance "), F.lit("$77.10"))).otherwise(F.lit(", then $77.10")))
    return _orders(spark, sf_dir).select("line_number", ev.amount_matches_source(text, money).alias("found"), ev.amount_evidence_is_balance(text, F.lit("$77.10")).alias("is_balance"))


@query("SELECT c_custkey, replace(replace(replace(c_name || '|' || chr(92) || c_mktsegment || chr(10) || 'end', chr(92), chr(92) || chr(92)), '|', chr(92) || '|'), chr(10), ' ') AS cell FROM customer")
def table_cells(spark, sf_dir):
    text = F.concat("c_name", F.lit("|\\"), "c_mktsegment", F.lit("\nend"))
    return table(spark, sf_dir, "customer").select("c_custkey", report.cell(text).alias("cell"))


@query(
    """SELECT o_orderkey AS line_number, CASE WHEN o_orderkey % 3 = 0 THEN 'pets' END AS model_category, CASE WHEN o_orderkey % 3 = 0 THEN 'pets' END AS category, CASE WHEN o_orderkey % 3 = 0 THEN 0.75 END AS confidence FROM orders"""
)
def complete_lines(spark, sf_dir):
    """Lines without a date or an amount keep their row and get no category."""
    k = F.col("line_number")
    text = F.when(k % 3 == 0, F.concat(F.lit("2024-01-02 shop "), F.col("money"))).when(k % 3 == 1, F.concat(F.lit("shop "), F.col("money"))).otherwise(F.lit("2024-01-02 shop"))
    lines = _orders(spark, sf_dir).select((k % 100).cast("string").alias("log_id"), k, text.alias("source_text"))
    said = lines.select("log_id", "line_number", F.lit("pets").alias("choice"), F.lit(0.75).cast("double").alias("confidence"), F.create_map(F.lit("pets"), F.lit(0.75).cast("double")).alias("probabilities"))
    return policy.categorise(parsing.parse(lines), said).select("line_number", "model_category", "category", F.col("confidence").cast("decimal(10,2)").cast("double").alias("confidence"))


_TREATED = """WITH n AS (SELECT o_custkey AS log_id, CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS INTEGER) AS line_number, o_orderkey AS k, o_orderstatus || left(o_orderpriority, 1) AS t FROM orders),
  l AS (SELECT *, k % 7 <> 0 AS complete, CASE WHEN t LIKE '%1' THEN 'uncategorized' ELSE 'other' END AS category, CASE WHEN t LIKE 'F%' THEN 5 ELSE -5 END AS amount, k % 2 = 0 AS confirmed FROM n),
  p AS (SELECT *, coalesce(complete AND confirmed AND lag(t) OVER w = t AND lag(complete) OVER w, false) AS dup FROM l WINDOW w AS (PARTITION BY log_id ORDER BY line_number)),
  o AS (SELECT *, CASE WHEN dup THEN last_value(CASE WHEN NOT dup THEN line_number END IGNORE NULLS) OVER (PARTITION BY log_id ORDER BY line_number ROWS UNBOUNDED PRECEDING) END AS origin FROM p),
  r AS (SELECT *, CASE WHEN NOT complete THEN 'unparsed' WHEN dup THEN 'excluded_duplicate' WHEN category <> 'uncategorized' THEN 'included_spending' WHEN amount < 0 THEN 'uncategorized_credit' ELSE 'uncategorized_outflow' END AS treatment FROM o)
"""


def _treated(spark, sf_dir):
    """Each customer's orders as a log: even keys are confirmed duplicates, every seventh line lacks its date."""
    o, k = table(spark, sf_dir, "orders"), F.col("o_orderkey")
    number = F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderkey"))
    text = F.concat("o_orderstatus", F.left("o_orderpriority", F.lit(1)))
    rows = o.select(F.col("o_custkey").alias("log_id"), number.alias("line_number"), k, text.alias("source_text"))
    text = F.col("source_text")
    rows = rows.select(
        "log_id",
        "line_number",
        k,
        "source_text",
        F.when(k % 7 != 0, F.lit("2024-01-02").cast("date")).alias("occurred_on"),
        text.alias("description"),
        F.when(text.startswith("F"), 5).otherwise(-5).cast("decimal(18,2)").alias("amount"),
        F.when(text.endswith("1"), "uncategorized").otherwise("other").alias("category"),
    )
    return reconcile.reconcile(rows, rows.filter(k % 2 == 0).select("log_id", "line_number"))


@query(_TREATED + "SELECT log_id, line_number, treatment FROM r")
def treatments(spark, sf_dir):
    return _treated(spark, sf_dir).select("log_id", "line_number", "treatment")


@query(_TREATED + "SELECT log_id, line_number, origin AS duplicate_of FROM r WHERE treatment = 'excluded_duplicate'")
def confirmed_duplicates(spark, sf_dir):
    return _treated(spark, sf_dir).filter("duplicate_of is not null").select("log_id", "line_number", "duplicate_of")


_SHOWN = "CASE WHEN {0} < 0 THEN '-$' ELSE '$' END || format('{{:,}}', CAST(trunc(abs({0})) AS BIGINT)) || '.' || lpad(CAST(CAST(abs({0}) * 100 AS BIGINT) % 100 AS VARCHAR), 2, '0')"
_MONTH, _LIST = "strftime(m, '%B %Y')", "coalesce(nullif(array_to_string(lines, ', '), ''), '—')"


@query(
    _W
    + f"""SELECT 'ledger' AS part, row_number() OVER (ORDER BY line_number) AS place, concat_ws(' ~ ', line_number, 'order' || chr(92) || '|' || line_number, occurred_on, 'order', {_SHOWN.format("amount")}, {_LABEL}, replace(treatment, '_', ' '), coalesce(policy_note, '')) AS cells FROM tx
    UNION ALL SELECT 'categories', row_number() OVER (ORDER BY m, category), concat_ws(' ~ ', {_MONTH}, {_LABEL}, {_SHOWN.format("amount")}, {_LIST}) FROM ct
    UNION ALL SELECT 'months', row_number() OVER (ORDER BY m), concat_ws(' ~ ', {_MONTH}, {_SHOWN.format("classified")}, {_SHOWN.format("unresolved")}, {_SHOWN.format("observed")}, {_LIST}) FROM mt
    UNION ALL SELECT 'changes', row_number() OVER (ORDER BY from_month, abs(change) DESC, category), concat_ws(' ~ ', strftime(from_month, '%B %Y') || ' → ' || strftime(to_month, '%B %Y'), {_LABEL}, {_SHOWN.format("previous")}, {_SHOWN.format("current")}, {_SHOWN.format("change")}, {_LIST}) FROM de"""
)
def report_cells(spark, sf_dir):
    """Rows of cells of the report's ledger, categories, months and changes."""
    tx = ledger(spark, sf_dir)
    full = tx.select("*", F.concat(F.lit("order|"), F.col("line_number").cast("string")).alias("source_text"), F.lit("order").alias("description"), F.array().cast("array<string>").alias("issues"))
    ct, mt = totals.monthly_category_totals(tx, lines=True), totals.monthly_totals(tx, lines=True)
    budgets, deltas = totals.budget_comparisons(ct, mt, targets(spark), totals.coverage(tx)), totals.month_deltas(ct, mt)
    summary = totals.reconciliation(tx, ct, mt, lines=True)
    rows = findings.evidence(budgets, deltas, summary)
    chosen = findings.findings(findings.default_selection(rows, findings.required_ids(budgets, deltas, summary.select("log_id"))), rows)
    analysis = SimpleNamespace(transactions=full, category_totals=ct, month_totals=mt, budgets=budgets, deltas=deltas, reconciliation=summary, parsed=full, findings=chosen)
    named = F.element_at(F.array(*map(F.lit, report.PARTS)), F.col("part") + 1)
    cells = report.cells(analysis).select(named.alias("part"), F.col("place").cast("long").alias("place"), F.array_join("cells", " ~ ").alias("cells"))
    return cells.filter(F.col("part").isin("ledger", "categories", "months", "changes"))


@query("SELECT o_orderkey AS line_number, CAST(o_orderdate AS DATE) AS occurred_on, CAST(o_totalprice AS DECIMAL(18,2)) AS amount FROM orders")
def cascade_without_answers(spark, sf_dir):
    """Lines that need no answer pass the cascade unchanged."""
    from ..operators import decisions

    parsed = parsing.parse(rendered(spark, sf_dir))
    years = parsed.select("log_id").distinct().withColumn("inferred_year", F.lit(None).cast("int"))
    none = spark.createDataFrame([], "log_id string, line_number long, field string, choice string, probabilities map<string,double>")
    return decisions.apply_choices(parsed, none, years).select("line_number", "occurred_on", "amount")
