"""Operators that prepare training text, built on the Spark DataFrame API.

Nothing else in the library imports this subpackage. Every operator takes and
returns DataFrames; ``queries.py`` registers one query per operator.
"""
