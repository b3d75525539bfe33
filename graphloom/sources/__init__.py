"""Sources of the pattern matching engine."""
