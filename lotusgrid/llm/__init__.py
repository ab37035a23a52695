"""Operators for text of training corpora; nothing outside this package imports it."""
