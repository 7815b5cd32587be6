"""Operators for preparing language-model training data.

Nothing else in the library imports this subpackage. Every operator takes and
returns DataFrames; `queries.py` binds them to the given tables.
"""
