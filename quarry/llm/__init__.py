"""Training-data operators: one module for each, plus the queries that apply them.

Nothing outside this subpackage imports it.
"""
