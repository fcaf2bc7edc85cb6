"""Relational operators: deduplication, splits, decontamination, retrieval, rows, evaluation, logs."""
