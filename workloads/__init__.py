"""Test data derived from the given tables, and the queries checked against SQL."""
