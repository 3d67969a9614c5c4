"""Operators for preparing training data at scale.

Each module holds one operator; `queries.py` registers a query for each.  Nothing outside this
subpackage imports it.
"""
