"""The event log as Structured Streaming."""
