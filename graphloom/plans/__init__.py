"""Plans of the pattern matching engine."""
