"""Operators of the layout engine."""
