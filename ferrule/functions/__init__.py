"""Expressions and builtin functions as Columns."""
