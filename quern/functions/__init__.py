"""Column expressions: text analysis and scoring."""
