"""Training-data operators on Spark: one module per operator, queries in ``queries.py``.

Nothing else in the package imports this subpackage.
"""
