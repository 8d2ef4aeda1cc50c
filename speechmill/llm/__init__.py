"""Operators for building language-model training data at corpus scale.

Nothing else in the library imports this subpackage. Every operator takes a
DataFrame and column names, selects only the columns it needs (so clashing
extra columns never matter) and returns a DataFrame. The thin queries that the
entry point registers live in :mod:`speechmill.llm.queries`.
"""
