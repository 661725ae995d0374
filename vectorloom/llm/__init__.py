"""Operators for preparing training text: filtering, deduplication, mixing, tokens, packing.

Nothing outside this package imports it. Every operator takes DataFrames and reads whole
tables; what it does with nulls, empty texts, ties and empty tables is in its docstring.
"""
