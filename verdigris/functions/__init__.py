"""Expressions over columns."""
