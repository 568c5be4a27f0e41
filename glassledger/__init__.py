"""Ledger review, 1099 preparation and document lookup as Spark DataFrame operators."""
