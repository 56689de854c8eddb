"""Streaming forms of the operators."""
