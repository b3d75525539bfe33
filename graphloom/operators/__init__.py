"""Operators of the pattern matching engine."""
