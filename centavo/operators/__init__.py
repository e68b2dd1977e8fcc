"""Operators of the transaction engine."""
