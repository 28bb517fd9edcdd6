"""Operators for preparing training data: documents in, decisions per document out.

Nothing else in the library imports this package. Each module holds one
operator with its general interface; ``queries.py`` registers the thin
``opN_<name>`` queries with their production parameters.
"""
