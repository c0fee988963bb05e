"""Readers and writers: JSON lines, schemas, segment tables."""
