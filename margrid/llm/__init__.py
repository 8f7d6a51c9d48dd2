"""Operators of a training-data pipeline; their queries are in ``margrid.llm.queries``."""
