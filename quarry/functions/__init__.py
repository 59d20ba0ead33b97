"""Column-level functions: predicates, periods, text, privacy."""
