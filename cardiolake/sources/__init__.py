"""Readers of recordings, annotations and lists."""
