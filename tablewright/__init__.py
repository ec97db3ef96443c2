"""Typed tabular data jobs on PySpark: every operator takes and returns DataFrames."""
