"""Text forms of money, months, line lists, rates and durations, and text scrubbing."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# Secret shapes, in the order in which they are replaced.
SECRETS = (
    r"""(?i)\b(?:OPEN_ROUTER_KEY|TYPESAFE_API_KEY|OPENAI_API_KEY|GITHUB_TOKEN)(?:\\?["'])?\s*[:=]\s*(?:\\".*?\\"|"(?:\\.|[^"\\])*"|'(?:\\.|[^'\\])*'|[^\s,;}\]]+)""",
    r"\bsk-(?:or-v1-|proj-)?[A-Za-z0-9_-]{12,}\b",
    r"\bgithub_pat_[A-Za-z0-9_]{12,}\b",
    r"\b(?:sk|ghp|gho|ghu|ghs)_[A-Za-z0-9_-]{12,}\b",
    r"(?i)\bBearer\s+[A-Za-z0-9._~+/-]{12,}",
)
REDACTED = "[REDACTED]"
DINING_LABEL = "Dining & Coffee"


def redact(text: Column) -> Column:
    for pattern in SECRETS:
        text = F.regexp_replace(text, pattern, F.lit(REDACTED))
    return text


def strip_code_fence(text: Column) -> Column:
    """The inside of a reply that is one code fence, else the reply; trimmed."""
    plain = F.regexp_replace(text, r"(?U)^\s+|\s+$", "")
    fence = r"(?is)^```(?:json)?[ \t]*\r?\n(.*)\r?\n```[ \t]*$"
    return F.when(plain.rlike(fence), F.regexp_extract(plain, fence, 1)).otherwise(plain)


def scrub_user_name(text: Column, user_name: str) -> Column:
    """Account folder names after /users/ or /home/, whatever their case."""
    if not user_name:
        return text
    pattern = r"(?iU)([/\\](?:users|home)[/\\]+)" + re.escape(user_name) + r"(?=$|[/\\\s\"'])"
    return F.regexp_replace(text, pattern, "$1<user>")


def money(amount: Column) -> Column:
    text = F.concat(F.lit("$"), F.format_number(F.abs(amount), 2))
    return F.when(amount < 0, F.concat(F.lit("-"), text)).otherwise(text)


def finding_money(amount: Column) -> Column:
    """As in finding texts: the sign follows the dollar."""
    return F.concat(F.lit("$"), F.format_number(amount, 2))


def month_name(month: Column) -> Column:
    return F.date_format(month, "MMMM yyyy")


def period(month: Column) -> Column:
    return F.date_format(month, "yyyy-MM")


def category_name(category: Column) -> Column:
    return F.when(category == "dining_coffee", DINING_LABEL).otherwise(F.initcap(F.replace(category, F.lit("_"), F.lit(" "))))


def line_numbers(lines: Column) -> Column:
    return F.when(F.size(lines) > 0, F.array_join(lines.cast("array<string>"), ", ")).otherwise("—")


def within_tolerance(actual: Column, expected: Column, tolerance: str = "0.01") -> Column:
    """Whether a decimal is near any accepted value; null is not."""
    near = F.exists(expected, lambda x: F.abs(actual - x) <= F.lit(tolerance).cast("decimal(18,2)"))
    return F.coalesce(near, F.lit(False))


def pass_rate_text(rate: Column) -> Column:
    """Floored, so that a rate below a minimum never reads as reaching it."""
    return F.concat(F.floor(F.round(rate * 100, 6)).cast("string"), F.lit("%"))


def duration_text(seconds: Column) -> Column:
    whole = F.bround(seconds).cast("long")
    minutes = F.floor(whole / 60).cast("long")
    return (
        F.when(seconds < 10, F.concat(tenths(seconds.cast("double")).cast("string"), F.lit("s")))
        .when(whole < 60, F.format_string("%ds", whole))
        .when(whole < 3600, F.format_string("%dm %02ds", minutes, whole % 60))
        .otherwise(F.format_string("%dh %02dm", F.floor(whole / 3600).cast("long"), F.floor(whole % 3600 / 60).cast("long")))
    )


def reduction_percent(original: Column, retained: Column) -> Column:
    """100 (original - retained) / original to one place in exact integers, ties to even (null without text)."""
    thousand = (original - retained) * 1000
    low = ((thousand - F.pmod(thousand, original)) / original).cast("long")
    twice = F.pmod(thousand, original) * 2
    up = F.when(twice > original, 1).when((twice == original) & (low % 2 == 1), 1).otherwise(0)
    return F.when(original > 0, ((low + up) / 10).cast("decimal(10,1)"))


def tenths(value: Column) -> Column:
    """A double from 0 to under 128 to one place as its exact binary value rounds (a written tie such as 66.65 lies above or
    below itself; true ties go to the even side), as decimal(10,1)."""
    whole = F.floor(value * 2**20)  # products and differences of powers of two are exact
    rest = F.floor((value * 2**20 - whole) * 2**52)
    ten = (whole.cast("decimal(20,0)") * F.lit(10 * 2**52).cast("decimal(18,0)") + (rest * 10).cast("decimal(20,0)")).cast("decimal(38,0)")
    one = F.lit(str(2**72)).cast("decimal(25,0)")
    low = F.call_function("div", ten, one)
    twice = ((ten - low.cast("decimal(12,0)") * one) * 2).cast("decimal(38,0)")
    up = F.when(twice > one, 1).when((twice == one) & (low % 2 == 1), 1).otherwise(0)
    return ((low + up) / 10).cast("decimal(10,1)")


def float_reduction_percent(original: Column, retained: Column) -> Column:
    """The same as a binary float rounds it; null without text. Characters are below 2^46."""
    percent = 100 * F.abs(original - retained).cast("double") / original.cast("double")
    return F.when(original > 0, tenths(percent).cast("double") * F.when(retained > original, -1.0).otherwise(1.0))
