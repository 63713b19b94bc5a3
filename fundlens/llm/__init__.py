"""Operators for large text corpora; self-contained, nothing else in the library imports it."""
