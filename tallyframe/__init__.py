"""A PySpark-native batch engine for evidence-carrying ledger analytics."""
