"""Operators for preparing training text, one module per operator.

Nothing outside this package imports it; the registered queries over the
test tables are in ``queries.py`` and their SQL in ``oracle.py``.
"""
