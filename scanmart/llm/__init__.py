"""Operators of a training-data pipeline: ten text operators, their queries and SQL.

Nothing else in the library imports this package. General helpers (the shared
checkpoint folder) come from the library.
"""
