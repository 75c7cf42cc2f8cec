"""The whole analysis of text logs, from lines to three findings, as one set of lazy DataFrames."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame

from ..operators import decisions, findings, parsing, policy, reconcile, totals
from ..sources.settings import Settings


@dataclass(frozen=True)
class Analysis:
    parsed: DataFrame
    transactions: DataFrame
    category_totals: DataFrame
    month_totals: DataFrame
    budgets: DataFrame
    deltas: DataFrame
    reconciliation: DataFrame
    evidence: DataFrame
    required: DataFrame
    selection: DataFrame
    findings: DataFrame


def analyse(lines: DataFrame, category_decisions: DataFrame, confirmed: DataFrame, settings: Settings | None = None, choices: DataFrame | None = None, proposals: DataFrame | None = None, selection: DataFrame | None = None, listed: bool = True, keep: str | None = None) -> Analysis:
    """lines (log_id, line_number, source_text); decisions, choices and proposals are tables that models filled before.

    ``validate`` checks everything that must hold; nothing runs before an action. ``listed``: figures list the lines behind
    them, as a report writes them out; without, ``totals.category_lines`` and the others give them as runs. ``keep``: a folder
    into which categorised lines and transactions are written once, at this call; without it every result reads the lines anew.
    """
    settings = settings or Settings()
    spark = lines.sparkSession
    parsed = parsing.parse(lines)
    years = parsing.infer_years(parsing.year_evidence(lines))
    if choices is not None:
        parsed = decisions.apply_choices(parsed, choices, years, settings.threshold)
    if proposals is not None:
        parsed = decisions.merge_attempts(parsed, proposals, years)
    tx = _kept(reconcile.reconcile(_kept(policy.categorise(parsed, category_decisions), keep, "lines"), confirmed), keep, "transactions")
    category_totals, month_totals = totals.monthly_category_totals(tx, listed), totals.monthly_totals(tx, listed)
    budgets = totals.budget_comparisons(category_totals, month_totals, settings.targets(spark), totals.coverage(tx))
    deltas = totals.month_deltas(category_totals, month_totals)
    summary = totals.reconciliation(tx, category_totals, month_totals, listed)
    evidence = findings.evidence(budgets, deltas, summary)
    required = findings.required_ids(budgets, deltas, summary.select("log_id"))
    selection = findings.default_selection(evidence, required) if selection is None else selection
    return Analysis(parsed, tx, category_totals, month_totals, budgets, deltas, summary, evidence, required, selection, findings.findings(selection, evidence))


def _kept(df: DataFrame, keep: str | None, name: str) -> DataFrame:
    if keep is None:
        return df
    df.write.mode("overwrite").parquet(f"{keep}/{name}")
    return df.sparkSession.read.schema(df.schema).parquet(f"{keep}/{name}")


def validate(lines: DataFrame, confirmed: DataFrame, result: Analysis) -> None:
    """Raise where the input, the confirmations, the balance or the selection does not hold."""
    reconcile.validate(reconcile.input_problems(lines, confirmed), "input")
    reconcile.validate(reconcile.unmatched_confirmations(result.transactions, confirmed), "confirmed lines are no duplicates")
    reconcile.validate(result.reconciliation.filter("not is_balanced").select("log_id"), "totals do not reconcile")
    reconcile.validate(findings.selection_problems(result.selection, result.evidence, result.required), "selection")
