"""The polling work as Structured Streaming queries."""
