"""Operators of a large-scale training-data pipeline.

Nothing outside this package imports it; ``llm.queries`` holds the registered
queries and their oracle SQL.
"""
