"""Functions of the pattern matching engine."""
