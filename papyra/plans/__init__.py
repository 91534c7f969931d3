"""Queries over the test tables: each binds operators to them and has its SQL beside it."""
