"""Expressions and constants that the operators share."""
