"""Conversation analytics on Spark: ingestion, analysis runs, dashboards, evaluation."""
