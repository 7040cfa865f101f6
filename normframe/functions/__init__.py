"""Column expressions with the engine's numeric rules, independent of any layout."""
