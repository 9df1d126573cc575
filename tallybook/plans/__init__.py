"""Compositions of operators: named queries, report datasets, full run."""
