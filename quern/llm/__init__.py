"""Operators for large text corpora: deduplication, leakage, term statistics, packing, redaction, rank fusion."""
