"""Settings from the environment or a file of assignments: budget targets and the decision threshold."""

from __future__ import annotations

import os
from dataclasses import dataclass
from decimal import Decimal, InvalidOperation

from pyspark.sql import DataFrame, SparkSession


def _money(text: str, name: str) -> Decimal:
    try:
        value = Decimal(text)
    except InvalidOperation:
        raise ValueError(f"{name} is not a number: {text}") from None
    if not value.is_finite() or value <= 0 or value.as_tuple().exponent < -2:
        raise ValueError(f"{name} must be above 0 with at most two decimals: {text}")
    return value


def read_assignments(path: str) -> dict[str, str]:
    """NAME=value lines of a file; blank lines and comments are left out, ``export`` and quotes are taken off."""
    out = {}
    with open(path, encoding="utf-8") as f:
        for line in f:
            name, equals, value = line.strip().removeprefix("export ").partition("=")
            if equals and not name.startswith("#"):
                value = value.strip()
                out[name.strip()] = value[1:-1] if len(value) > 1 and value[0] == value[-1] and value[0] in "\"'" else value
    return out


@dataclass(frozen=True)
class Settings:
    """Fixed defaults: monthly targets of 260.00 for dining and 1200.00 for shopping, threshold 0.8."""

    dining_target: Decimal = Decimal("260.00")
    shopping_target: Decimal = Decimal("1200.00")
    threshold: float = 0.8

    @staticmethod
    def from_environment(environ=None, path: str | None = None) -> Settings:
        """The environment's values go before those of the file."""
        env = (read_assignments(path) if path else {}) | dict(os.environ if environ is None else environ)
        threshold = float(env.get("DECISION_THRESHOLD", 0.8))
        if not 0 <= threshold <= 1:
            raise ValueError(f"DECISION_THRESHOLD must be in [0, 1]: {threshold}")
        return Settings(_money(env.get("DINING_TARGET", "260.00"), "DINING_TARGET"), _money(env.get("SHOPPING_TARGET", "1200.00"), "SHOPPING_TARGET"), threshold)

    def targets(self, spark: SparkSession) -> DataFrame:
        rows = [("dining_coffee", self.dining_target), ("shopping", self.shopping_target)]
        return spark.createDataFrame(rows, "category string, target decimal(18,2)")
