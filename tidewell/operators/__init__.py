"""Bag, pair and key-value operators: DataFrame to DataFrame."""
