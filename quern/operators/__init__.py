"""Index building, retrieval, statistics and skew-safe building blocks."""
