"""Operators for building training data, their queries and SQL. Nothing outside this folder imports it."""
