"""Equivalent SQL of the queries."""
