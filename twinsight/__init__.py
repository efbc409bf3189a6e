"""Overlap and duplicate detection for work items, on Spark."""
