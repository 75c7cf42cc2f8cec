"""Category policy: choices of a model, overruled by what the description itself establishes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import evidence as ev

# The category catalogue and the policy's words.
CATEGORIES = (
    "housing bills_utilities groceries dining_coffee transportation travel health_fitness insurance education_childcare shopping personal_care "
    "entertainment subscriptions pets gifts_donations taxes_government_fees financial_fees_interest work_expenses other uncategorized"
).split()
MIXED_RETAILERS = ("Target", "Amazon", "Costco")
KNOWN_MERCHANTS = {
    "Shell": "transportation",
    "Steam": "entertainment",
    "Best Buy": "shopping",
    "Home Depot": "shopping",
    "REI": "shopping",
    "Barnes & Noble": "entertainment",
    "Walgreens": "health_fitness",
    "Thai Orchid": "dining_coffee",
    "IKEA": "shopping",
    "Kroger": "groceries",
    "Aldi": "groceries",
}
PURPOSE = (
    r"(?U)\b(?:rent|mortgage|grocer(?:y|ies)|dinner|lunch|breakfast|meal|utility|utilities|electric|internet|phone|gas|fuel|parking|flight|hotel|"
    r"lodging|medical|pharmacy|tuition|childcare|gift|donation)\b"
)
CASH_MOVEMENT = r"(?U)^(?:zelle\b|venmo\b|atm (?:cash )?withdrawal|cash withdrawal|paypal (?:transfer|payment)|bank transfer|ach transfer|wire transfer)"
CASH_NOTE = "Cash movement without an identified spending purpose"
MIXED_NOTE = "Merchant-only mixed retailer charge; item type is not stated"
KNOWN_NOTE = "Known expense merchant: "


def is_cash_movement(description: Column) -> Column:
    plain = F.btrim(F.regexp_replace(F.lower(description), r"(?U)\s+", " "))
    return plain.rlike(CASH_MOVEMENT) & ~plain.rlike(PURPOSE)


def merchants(spark) -> DataFrame:
    """Known merchants: lower-cased name, written name, category and rank; a fixed, small table."""
    rows = [(name.lower(), name, category, k) for k, (name, category) in enumerate(KNOWN_MERCHANTS.items())]
    return spark.createDataFrame(rows, "merchant_key string, merchant string, merchant_category string, merchant_rank int")


def apply_policy(rows: DataFrame, description: str = "description", model_category: str = "model_category", known: DataFrame | None = None, mixed=MIXED_RETAILERS) -> DataFrame:
    """Adds category and policy_note: cash movement, known merchant, mixed retailer, else the model's category.

    ``known`` has one row for each merchant_key, so it may be any size; the default catalogue is broadcast.
    """
    known = F.broadcast(merchants(rows.sparkSession)) if known is None else known
    name = F.lower(ev.merchant_name(F.col(description)))
    joined = rows.withColumn("merchant_key", name).join(known.select("merchant_key", "merchant", "merchant_category"), "merchant_key", "left")
    cash = is_cash_movement(F.col(description))
    is_mixed = F.col("merchant_key").isin([m.lower() for m in mixed])
    category = (
        F.when(F.col(description).isNull(), F.col(model_category))
        .when(cash, "uncategorized")
        .when(F.col("merchant").isNotNull(), F.col("merchant_category"))
        .when(is_mixed, "other")
        .otherwise(F.col(model_category))
    )
    note = F.when(cash, CASH_NOTE).when(F.col("merchant").isNotNull(), F.concat(F.lit(KNOWN_NOTE), F.col("merchant"))).when(is_mixed, MIXED_NOTE)
    joined = joined.withColumns({"category": category, "policy_note": F.when(F.col(description).isNotNull(), note)})
    return joined.drop("merchant_key", "merchant", "merchant_category")


def unknown_categories(choice: Column, probabilities: Column) -> Column:
    """Names of a decision that no category has, in order: the choice, then the map's keys."""
    names = F.array_distinct(F.concat(F.array(choice), F.map_keys(probabilities)))
    return F.array_except(names, F.array(*map(F.lit, CATEGORIES)))


def categorise(parsed: DataFrame, decisions: DataFrame) -> DataFrame:
    """Parsed lines with category columns; incomplete lines keep a null slot.

    decisions: log_id, line_number, choice, confidence, probabilities. A decision that names an unknown category fails.
    """
    complete = F.col("occurred_on").isNotNull() & F.col("amount").isNotNull() & F.col("description").isNotNull()
    checked = decisions.withColumn("_unknown", unknown_categories(F.col("choice"), F.col("probabilities")))
    wrong = F.raise_error(F.concat(F.lit("not a known expense category: "), F.array_join("_unknown", ", ")))
    checked = checked.select("log_id", "line_number", F.when(F.size("_unknown") > 0, wrong.cast("string")).otherwise(F.col("choice")).alias("model_category"), "confidence", "probabilities")
    rows = parsed.join(checked, ["log_id", "line_number"], "left")
    rows = rows.withColumns({c: F.when(complete, F.col(c)) for c in ("model_category", "confidence", "probabilities")})
    rows = apply_policy(rows)
    decided = F.col("model_category").isNotNull()
    return rows.withColumns({c: F.when(decided, F.col(c)) for c in ("category", "policy_note")})
