"""Bindings of the operators to tables, with the same questions in SQL."""
