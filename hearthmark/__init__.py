"""Listing analytics as Spark DataFrame operators."""
