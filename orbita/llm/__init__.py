"""Operators for large text and candidate collections. Nothing outside this package imports it."""
