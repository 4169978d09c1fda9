"""Inputs: Parquet tables with stable row ids, and the seeded workload generator."""
