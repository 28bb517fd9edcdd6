"""Compositions of operators: checkout, stand-in batches, the query registry."""
