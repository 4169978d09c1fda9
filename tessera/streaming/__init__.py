"""Feeding versioned tables from streams."""
