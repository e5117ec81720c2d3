"""Readers: repositories, tool output, change feeds."""
