"""Operators for preparing training text at corpus scale.

Nothing else in the library imports this subpackage. Every operator takes and returns DataFrames;
the thin queries that bind them to the test tables are in ``queries``.
"""
