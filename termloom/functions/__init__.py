"""Column expressions: text analysis, paths and scoring."""
