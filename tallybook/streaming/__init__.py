"""Incremental processing of newly arrived exports."""
