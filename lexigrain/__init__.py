"""Spark-first text analytics: cleaning funnel, labels, features, models and evaluation as DataFrame operators."""
