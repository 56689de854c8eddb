"""Spark engine for personal-data detection, tokenization and audit over tables of text and pages."""
