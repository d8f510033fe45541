"""Spark-first analytics for content streams: logs, routing, priorities, caches, catalogues and vectors."""
