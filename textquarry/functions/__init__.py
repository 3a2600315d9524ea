"""Column-level building blocks: patterns and globs."""
