"""From text lines to parsed lines: year inference and the field projection.

Lines are (log_id, line_number, source_text). Windows are over blocks of a log, so that one long log is many tasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import evidence as ev
from . import blocks

#: Fixed value: a step of so many months between neighbouring dated lines is a change of year.
ROLLOVER_MONTHS = 6


def with_dates(lines: DataFrame) -> DataFrame:
    """Adds the number of date candidates and year, month and day of a single one; each pattern is matched once a line."""
    rows = lines.withColumn("_dates", ev.date_candidates(F.col("source_text")))
    rows = rows.withColumn("_parts", F.when(F.size("_dates") == 1, ev.date_parts(F.get("_dates", F.lit(0)))))
    parts = F.col("_parts")
    return rows.withColumns({"_year": ev.year_of(parts), "_month": ev.month_of(parts), "_day": ev.day_of(parts), "_dates": F.size("_dates")}).drop("_parts")


def year_evidence(lines: DataFrame) -> DataFrame:
    """log_id, line_number, month and explicit year of every line; both null unless it has exactly one, valid date.

    Nothing is filtered out: a filter would be moved below the matches and repeat them.
    """
    rows = with_dates(lines.select("log_id", "line_number", "source_text"))
    valid = (F.col("_dates") == 1) & ev.calendar_date(F.coalesce("_year", F.lit(2000)), F.col("_month"), F.col("_day")).isNotNull()
    return rows.select("log_id", "line_number", F.when(valid, F.col("_month")).alias("month"), F.when(valid, F.col("_year")).alias("year"))


def infer_years(evidence: DataFrame, width: int | None = None) -> DataFrame:
    """log_id and the year that all its dates may share: the only explicit one, if no change of year lies between lines.

    Lines without a month are passed over; a log that has no other lines gives no row. A log is gone through in blocks (of
    ``width`` numbers): each gives its first and last dated line, its years and whether one changed inside.
    """
    order = blocks.inside(["log_id"], "line_number").rowsBetween(Window.unboundedPreceding, -1)
    dated = blocks.numbered(evidence, "line_number", width).withColumn("e", F.when(F.col("month").isNotNull(), F.struct("month", "year")))
    marked = dated.withColumn("crossed", _crossed(F.last("e", ignorenulls=True).over(order), F.col("e")))
    at = F.when(F.col("e").isNotNull(), F.col("line_number"))
    parts = marked.groupBy("log_id", "_block").agg(F.count("month").alias("n"), F.min("year").alias("first"), F.max("year").alias("last"), F.bool_or("crossed").alias("crossed"), F.min_by("e", at).alias("head"), F.max_by("e", at).alias("tail"))
    parts = parts.filter("n > 0").withColumn("between", _crossed(F.lag("tail").over(blocks.along(["log_id"])), F.col("head")))
    years = parts.groupBy("log_id").agg(F.min("first").alias("first"), F.max("last").alias("last"), F.bool_or(F.col("crossed") | F.col("between")).alias("crossed"))
    return years.select("log_id", F.when((F.col("first") == F.col("last")) & ~F.col("crossed"), F.col("first")).alias("inferred_year"))


def _crossed(before: Column, here: Column) -> Column:
    """Whether the year changes between two neighbouring dated lines."""
    same = F.coalesce(here["year"] == before["year"], F.lit(False))
    return F.coalesce((F.abs(here["month"] - before["month"]) >= ROLLOVER_MONTHS) & ~same, F.lit(False))


def parse(lines: DataFrame) -> DataFrame:
    """Each line's date, description, amount and ordered issues; lines are never dropped."""
    years = infer_years(year_evidence(lines))
    text = F.col("source_text")
    read = with_dates(lines).withColumns({"_amounts": ev.amount_candidates(text), "_plain": ev.tidy(ev.without_fields(text))})
    read = read.withColumn("_context", F.when(F.size("_amounts") == 1, ev.amount_context(text, 0)))
    rows = read.join(years, "log_id", "left").withColumn("_year", F.coalesce("_year", "inferred_year"))
    context, amounts = F.col("_context"), F.size("_amounts")
    day = F.when(F.col("_dates") == 1, ev.calendar_date(F.col("_year"), F.col("_month"), F.col("_day")))
    rows = rows.withColumns({"occurred_on": day, "_balance": ev.is_balance(context), "_value": F.when(amounts == 1, ev.parse_amount(F.get("_amounts", F.lit(0))))})
    rows = rows.withColumn("_read", ev.refund_adjusted(F.col("_value"), context))
    rows = rows.withColumn("amount", F.when((amounts == 1) & ~F.col("_balance"), F.col("_read")))
    rows = rows.withColumn("description", ev.named(F.col("_plain"), F.col("amount")))
    issues = F.array_compact(
        F.array(
            F.when(F.col("_dates") == 0, "missing_date")
            .when(F.col("_dates") > 1, "multiple_dates")
            .when(F.col("_year").isNull(), "year_not_inferable")
            .when(F.col("occurred_on").isNull(), "invalid_date"),
            F.when(amounts == 0, "missing_amount").when(amounts > 1, "multiple_amounts").when(F.col("_balance"), "nontransaction_amount"),
            F.when(F.col("description").isNull(), "missing_description"),
        )
    )
    return rows.select("log_id", "line_number", "source_text", "occurred_on", "description", "amount", issues.alias("issues"))


def uncertain(parsed: DataFrame) -> DataFrame:
    return parsed.filter(F.size("issues") > 0)


def replace_by_key(rows: DataFrame, replacements: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of ``replacements`` take the place of rows with the same key, column by column; all rows stay."""
    others = [c for c in rows.columns if c not in keys]
    new = replacements.select(*keys, *(F.col(c).alias(f"_new_{c}") for c in others), F.lit(True).alias("_replaced"))
    picked = [F.when(F.col("_replaced"), F.col(f"_new_{c}")).otherwise(F.col(c)).alias(c) for c in others]
    return rows.join(new, keys, "left").select(*keys, *picked).select(*rows.columns)
