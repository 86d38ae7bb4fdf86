"""Composite plans: the anomaly report and its summaries."""
