"""Column expressions: key bits, row addresses, grouping keys."""
