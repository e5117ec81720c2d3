"""Operators of the analysis engine."""
