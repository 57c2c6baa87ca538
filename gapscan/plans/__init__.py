"""Whole jobs composed of operators: gap outcomes, summaries, reports."""
