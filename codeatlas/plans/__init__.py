"""Composed reports, and the binding of every operator to the given tables."""
