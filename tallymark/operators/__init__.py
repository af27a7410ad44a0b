"""Relational operators: checks, history, reports, catalog and test data."""
