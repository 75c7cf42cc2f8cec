"""Recorded decisions and proposals applied to uncertain lines; each accepted field must be backed by the text.

Decisions: (log_id, line_number, field, choice, probabilities), field ``date`` or ``amount``, choices ``candidate_i`` (from
1) or ``none``. Proposals: (log_id, line_number, attempt, occurred_on, date_evidence, description, description_evidence,
amount, amount_evidence, amount_evidence_index). Models are never called inside a plan: their answers are tables.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import evidence as ev

THRESHOLD = 0.8
MAX_CANDIDATES = 254
ATTEMPTS = 2


def _picked(decisions: DataFrame, field: str, threshold: float) -> DataFrame:
    """Position (from 0) of the accepted candidate of one field."""
    sure = F.try_element_at("probabilities", F.col("choice")) >= threshold
    number = F.regexp_extract("choice", r"^candidate_(\d+)$", 1).try_cast("int") - 1
    return decisions.filter(F.col("field") == field).select("log_id", "line_number", F.when(sure & (F.col("choice") != "none"), number).alias(f"_{field}"))


def _without(issues: Column, condition: Column, *names: str) -> Column:
    return F.when(condition, F.array_except(issues, F.array(*map(F.lit, names)))).otherwise(issues)


def apply_choices(parsed: DataFrame, decisions: DataFrame, years: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """Lines whose only doubt is which date or amount counts; years: log_id, inferred_year. Lines without an answer stay."""
    rows = parsed.join(_picked(decisions, "date", threshold), ["log_id", "line_number"], "left").join(_picked(decisions, "amount", threshold), ["log_id", "line_number"], "left")
    rows = rows.join(years, "log_id", "left")
    text = F.col("source_text")
    dates, amounts = ev.date_candidates(text), ev.amount_candidates(text)
    fit = lambda c: F.size(c).between(2, MAX_CANDIDATES)
    day = F.when(F.array_contains("issues", "multiple_dates") & fit(dates), ev.parse_date_evidence(F.get(dates, F.col("_date")), F.col("inferred_year")))
    context = ev.amount_context(text, F.col("_amount"))
    amount = ev.refund_adjusted(ev.parse_amount(F.get(amounts, F.col("_amount"))), context)
    amount = F.when(F.array_contains("issues", "multiple_amounts") & fit(amounts) & ~ev.is_balance(context), amount)
    rows = rows.withColumns({"_day": day, "_sum": amount})
    issues = _without(_without(F.col("issues"), F.col("_day").isNotNull(), "multiple_dates"), F.col("_sum").isNotNull(), "multiple_amounts")
    final = F.coalesce("amount", "_sum").cast("decimal(18,2)")
    renamed = F.when(F.col("_sum").isNotNull(), ev.description(text, F.col("_sum"))).otherwise(F.col("description"))
    return rows.select("log_id", "line_number", "source_text", F.coalesce("occurred_on", "_day").alias("occurred_on"), renamed.alias("description"), final.alias("amount"), issues.alias("issues"))


def merge_proposals(parsed: DataFrame, proposals: DataFrame, years: DataFrame) -> DataFrame:
    """One round: proposed fields that are backed by the text fill fields that are still missing."""
    p = proposals.select("log_id", "line_number", *(F.col(c).alias(f"p_{c}") for c in ("occurred_on", "date_evidence", "description", "description_evidence", "amount", "amount_evidence", "amount_evidence_index")))
    rows = parsed.join(p, ["log_id", "line_number"], "left").join(years, "log_id", "left")
    text = F.col("source_text")
    # each pattern is matched once, and only on lines with a proposal for a field that is missing
    dated = F.col("occurred_on").isNull() & F.col("p_date_evidence").isNotNull() & F.col("p_occurred_on").isNotNull()
    priced = F.col("amount").isNull() & F.col("p_amount_evidence").isNotNull() & F.col("p_amount").isNotNull()
    same_date = F.array_contains(ev.date_candidates(text), F.col("p_date_evidence")) & (ev.parse_date_evidence(F.col("p_date_evidence"), F.col("inferred_year")) == F.col("p_occurred_on"))
    day = F.when(dated & same_date, F.col("p_occurred_on"))
    rows = rows.withColumn("_amounts", F.when(priced, ev.amount_candidates(text)))
    rows = rows.withColumn("_places", F.filter(F.transform("_amounts", lambda a, i: F.when(a == F.col("p_amount_evidence"), i)), lambda i: i.isNotNull()))
    places = F.col("_places")
    at = F.coalesce(F.when(F.array_contains(places, F.col("p_amount_evidence_index")), F.col("p_amount_evidence_index")), F.when(F.size(places) == 1, F.get(places, F.lit(0))))
    rows = rows.withColumn("_at", at)
    rows = rows.withColumn("_context", F.when(F.col("_at").isNotNull(), ev.amount_context(text, F.col("_at"))))
    context = F.col("_context")
    rows = rows.withColumn("_read", F.when(context.isNotNull(), ev.refund_adjusted(ev.parse_amount(F.col("p_amount_evidence")), context)))
    good = context.isNotNull() & ~ev.is_balance(context) & (F.col("_read") == F.col("p_amount").try_cast("decimal(18,2)"))
    name = F.col("p_description_evidence")
    named = F.col("description").isNull() & name.isNotNull() & text.contains(name) & (F.btrim(name) == F.btrim("p_description")) & ev.has_descriptive_text(name)
    rows = rows.withColumns({"_day": day, "_sum": F.when(good, F.col("_read")), "_name": F.when(named, F.btrim("p_description"))})
    issues = _without(F.col("issues"), F.col("_day").isNotNull(), "missing_date", "multiple_dates", "year_not_inferable", "invalid_date")
    issues = _without(issues, F.col("_sum").isNotNull(), "missing_amount", "multiple_amounts")
    issues = _without(issues, F.col("_name").isNotNull(), "missing_description")
    return rows.select("log_id", "line_number", "source_text", F.coalesce("occurred_on", "_day").alias("occurred_on"), F.coalesce("description", "_name").alias("description"), F.coalesce("amount", "_sum").cast("decimal(18,2)").alias("amount"), issues.alias("issues"))


def merge_attempts(parsed: DataFrame, proposals: DataFrame, years: DataFrame, attempts: int = ATTEMPTS) -> DataFrame:
    """At most two rounds; what a round settles stays, and lines still in doubt are marked at the end."""
    rows = parsed
    for attempt in range(1, attempts + 1):
        rows = merge_proposals(rows, proposals.filter(F.col("attempt") == attempt), years)
    failed = F.size("issues") > 0
    return rows.withColumn("issues", F.when(failed, F.array_append("issues", "llm_extraction_failed")).otherwise(F.col("issues")))


def probability_problems(decisions: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    """Probabilities outside [0, 1] or not finite, and keys without a partner on either side."""
    p = F.col("probability")
    wrong = decisions.filter(p.isNull() | F.isnan(p.cast("double")) | ~p.between(0, 1)).select(key, F.lit("probability is not in [0, 1]").alias("problem"))
    more = decisions.join(ids, key, "left_anti").select(key, F.lit("was not asked for").alias("problem"))
    less = ids.join(decisions, key, "left_anti").select(key, F.lit("has no decision").alias("problem"))
    return wrong.unionByName(more).unionByName(less)
