"""Operators: DataFrame -> DataFrame building blocks (clean, reshape, panel, features,
split, quantile, evaluate, linear, trees, importance, report)."""
