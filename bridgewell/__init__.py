"""Bridgewell: DataFrame operators and pipelines for cross-domain product matching on Spark."""
