"""Operators for training-data pipelines.

Nothing outside this package imports it.  Each module holds one operator with a general interface;
``queries`` holds the thin registered queries and their SQL.
"""
