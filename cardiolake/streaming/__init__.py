"""The live monitor on Structured Streaming."""
