"""Operators of a large-scale training-data pipeline.

Nothing else in the library imports this subpackage.  Each module holds one operator with a general
interface plus the thin query that `__spark_entry__` registers.
"""
