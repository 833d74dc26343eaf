"""Evaluation: layers, fixpoints, queries, entailment."""
