"""Palimpsest: hybrid retrieval, knowledge-base analytics and corpus preparation on Spark."""
