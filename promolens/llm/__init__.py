"""Operators for preparing training text and vectors at scale.

Nothing outside this package imports it.  Every operator takes DataFrames and
returns DataFrames; the registered queries are in ``queries``.
"""
