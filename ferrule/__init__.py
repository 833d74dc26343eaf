"""Declarative rules over graphs and tables, evaluated as Spark DataFrame plans."""
