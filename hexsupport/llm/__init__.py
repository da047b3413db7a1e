"""Operators for building training corpora at cluster scale.

Nothing else in the library imports this subpackage. Each module holds one
operator with its general interface; ``queries`` registers the thin queries.
"""
