"""Execution-plan documents flattened into tables."""
