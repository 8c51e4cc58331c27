"""Catalogue operators: DataFrame to DataFrame."""
