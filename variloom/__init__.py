"""Variant and genome-interval analytics on Spark."""
