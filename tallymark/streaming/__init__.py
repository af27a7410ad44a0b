"""Checks on arriving data."""
