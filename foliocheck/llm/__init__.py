"""Operators that turn a table of raw documents into training data."""
