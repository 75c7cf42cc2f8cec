"""Columns that read dates, amounts and descriptions out of one text line.

Every function takes and returns Columns and stays in the JVM. Null text gives null or empty results.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The evidence grammar.
MONTHS = "January|February|March|April|May|June|July|August|September|October|November|December|Jan|Feb|Mar|Apr|Jun|Jul|Aug|Sep|Sept|Oct|Nov|Dec"
MONTH_NUMBERS = {"jan": 1, "feb": 2, "mar": 3, "apr": 4, "may": 5, "jun": 6, "jul": 7, "aug": 8, "sep": 9, "oct": 10, "nov": 11, "dec": 12}
_DATE_BODY = (
    r"(?:(\d{4})-(\d{1,2})-(\d{1,2})"
    rf"|({MONTHS})\.?\s+(\d{{1,2}})(?:,?\s+(\d{{4}}|\d{{2}}))?"
    r"|(\d{1,2})[/-](\d{1,2})(?:[/-](\d{4}|\d{2}))?)"
)
DATE = rf"(?iU)(?<![\w/.-]){_DATE_BODY}(?!(?:[\w/-]|\.\d))"
WHOLE_DATE = rf"(?iU)^{_DATE_BODY}$"
_AMOUNT_BODY = r"(\(\s*\$?\s*\d+(?:,\d{3})*\.\d{2}\s*\)|(?:-\$|\$-|[-$])?\d+(?:,\d{3})*\.\d{2})"
AMOUNT = rf"(?iU)(?<![\w.,]){_AMOUNT_BODY}(?!(?:[\w.]|,\d))"
_FIELD = rf"(?iU)(?<![\w/.-]){_DATE_BODY}(?!(?:[\w/-]|\.\d))|(?<![\w.,]){_AMOUNT_BODY}(?!(?:[\w.]|,\d))"
REFUND = r"(?iU)\brefund\b|\breturn processed\b"
NO_REFUND = r"(?iU)\b(?:no|not|without|never)\s+refund\b"
LEADING_REFUND = r"(?iU)^(?:refund|return processed)\b[\s,|:-]*(?=\S)"
TRAILING_REFUND = r"(?iU)(?<=\S)[\s,|:-]*\brefund$"
BALANCE = r"(?iU)\bbalance\s*(?:of\s*)?:?\s*$"
EDGES = " \t,|:-()"
EVIDENCE_EDGES = " (),."


def date_candidates(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(DATE), 0)


def amount_candidates(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(AMOUNT), 1)


def amount_contexts(text: Column) -> Column:
    """Text before each amount, back to the amount before it; element i belongs to candidate i."""
    return F.split(text, AMOUNT, -1)


def amount_context(text: Column, index: Column | int) -> Column:
    return F.get(amount_contexts(text), F.lit(index) if isinstance(index, int) else index)


def amount_offset(text: Column, index: Column | int) -> Column:
    """Code points before candidate ``index``."""
    i = F.lit(index) if isinstance(index, int) else index
    before = F.aggregate(F.slice(amount_contexts(text), F.lit(1), i + 1), F.lit(0), lambda n, s: n + F.length(s))
    return before + F.aggregate(F.slice(amount_candidates(text), F.lit(1), i), F.lit(0), lambda n, s: n + F.length(s))


def _group(text: Column, pattern: str, *groups: int) -> Column:
    """The first of these groups that matched, as an integer."""
    return F.coalesce(*(F.nullif(F.regexp_extract(text, pattern, g), F.lit("")).try_cast("int") for g in groups))


def explicit_year(text: Column, pattern: str = DATE) -> Column:
    written = F.coalesce(*(F.nullif(F.regexp_extract(text, pattern, g), F.lit("")) for g in (1, 6, 9)))
    return F.when(F.length(written) == 2, written.try_cast("int") + 2000).otherwise(written.try_cast("int"))


def date_month(text: Column, pattern: str = DATE) -> Column:
    name = F.lower(F.left(F.regexp_extract(text, pattern, 4), F.lit(3)))
    by_name = F.create_map(*(F.lit(x) for pair in MONTH_NUMBERS.items() for x in pair))
    return F.coalesce(_group(text, pattern, 2), F.when(name != "", F.try_element_at(by_name, name)), _group(text, pattern, 7))


def date_day(text: Column, pattern: str = DATE) -> Column:
    return _group(text, pattern, 3, 5, 8)


def date_parts(candidate: Column) -> Column:
    """The nine groups of a date candidate (empty where unused), read by one match; what may follow is the end of a line."""
    return F.split(F.regexp_replace(candidate, WHOLE_DATE + r"\v*", "$1,$2,$3,$4,$5,$6,$7,$8,$9"), ",")


def _part(parts: Column, *groups: int) -> Column:
    return F.coalesce(*(F.nullif(F.get(parts, F.lit(g - 1)), F.lit("")) for g in groups))


def year_of(parts: Column) -> Column:
    written = _part(parts, 1, 6, 9)
    return F.when(F.length(written) == 2, written.try_cast("int") + 2000).otherwise(written.try_cast("int"))


def month_of(parts: Column) -> Column:
    by_name = F.create_map(*(F.lit(x) for pair in MONTH_NUMBERS.items() for x in pair))
    return F.coalesce(_part(parts, 2, 7).try_cast("int"), F.try_element_at(by_name, F.lower(F.left(_part(parts, 4), F.lit(3)))))


def day_of(parts: Column) -> Column:
    return _part(parts, 3, 5, 8).try_cast("int")


def calendar_date(year: Column, month: Column, day: Column) -> Column:
    """The date, or null where the calendar has none."""
    written = F.format_string("%04d-%02d-%02d", year, month, day)
    good = year.between(1, 9999) & month.between(1, 12) & day.between(1, 31)
    return F.when(good, F.try_to_date(written, "yyyy-MM-dd"))


def parse_date_evidence(evidence: Column, inferred_year: Column) -> Column:
    """Date of a text that is nothing but a date (FN-5); matched once, since a match a group makes code too long to compile."""
    text = F.btrim(evidence, F.lit(EVIDENCE_EDGES))
    parts = F.when(text.rlike(WHOLE_DATE), date_parts(text))
    return F.get(F.transform(F.array(parts), lambda p: calendar_date(F.coalesce(year_of(p), inferred_year), month_of(p), day_of(p))), F.lit(0))


def parse_amount(text: Column) -> Column:
    """Exact decimal; parentheses mean negative."""
    digits = F.regexp_replace(text, r"(?U)[$,()\s]", "").try_cast("decimal(18,2)")
    return F.when(text.startswith("("), -digits).otherwise(digits).cast("decimal(18,2)")


def is_balance(context: Column) -> Column:
    return context.rlike(BALANCE)


def is_refund(context: Column) -> Column:
    return context.rlike(REFUND) & ~context.rlike(NO_REFUND)


def refund_adjusted(amount: Column, context: Column) -> Column:
    return F.when((amount > 0) & is_refund(context), -amount).otherwise(amount).cast("decimal(18,2)")


def without_fields(text: Column) -> Column:
    """Text without its dates and amounts; spans are found on the original text at once."""
    return F.regexp_replace(text, _FIELD, "")


def tidy(text: Column) -> Column:
    once = F.btrim(text, F.lit(EDGES))
    once = F.btrim(F.regexp_replace(once, r"(?U)[\s\x1c-\x1f]+", " "))
    return F.btrim(once, F.lit(EDGES))


def merchant_name(description: Column) -> Column:
    """Description without the wording of a refund, unless nothing else is left."""
    bare = F.regexp_replace(F.regexp_replace(description, LEADING_REFUND, ""), TRAILING_REFUND, "")
    return F.when(is_refund(description), bare).otherwise(description)


def named(plain: Column, amount: Column) -> Column:
    """Description from a line without its fields, tidied; null if nothing is left."""
    return F.nullif(F.when(amount < 0, tidy(merchant_name(plain))).otherwise(plain), F.lit(""))


def description(text: Column, amount: Column) -> Column:
    return named(tidy(without_fields(text)), amount)


def has_descriptive_text(text: Column) -> Column:
    return without_fields(text).rlike(r"\p{L}")


def amount_matches_source(text: Column, evidence: Column) -> Column:
    """The evidence is one of the text's amounts, verbatim (FN-11)."""
    return F.array_contains(amount_candidates(text), evidence)


def amount_evidence_is_balance(text: Column, evidence: Column) -> Column:
    """Any occurrence of the evidence is a balance (FN-11)."""
    pairs = F.arrays_zip(amount_candidates(text).alias("a"), amount_contexts(text).alias("c"))
    return F.exists(pairs, lambda p: (p["a"] == evidence) & p["c"].rlike(BALANCE))
