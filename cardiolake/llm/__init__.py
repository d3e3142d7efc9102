"""Operators for building training data sets from large document tables."""
