"""Surveillance analytics on Spark: DataFrame operators over long-form abundance data."""
