"""Queries that put operators together, and their SQL."""
