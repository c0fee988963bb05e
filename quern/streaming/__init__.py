"""Near-real-time ingest with Structured Streaming."""
