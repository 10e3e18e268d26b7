"""Diagram-evaluation analytics as Spark DataFrame jobs."""
