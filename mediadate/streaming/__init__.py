"""The inventory and the corrections as Structured Streaming jobs."""
