"""Joins with their stages, grouped aggregation with its keys, views, and versioned tables."""
