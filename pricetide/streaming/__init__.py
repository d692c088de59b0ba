"""Incremental forms: streaming merges, member state and request limits."""
