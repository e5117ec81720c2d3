"""Whole runs: scan, diff, report, resume."""
