"""Weftlink: Spark-first entity resolution and corpus preparation."""
