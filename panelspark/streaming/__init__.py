"""Late and live data with Structured Streaming."""
