"""Live ingest with Structured Streaming."""
