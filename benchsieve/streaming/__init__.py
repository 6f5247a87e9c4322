"""Job event streams with Structured Streaming."""
