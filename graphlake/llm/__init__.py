"""Operators for building training data at scale.

Nothing else in the library imports this subpackage.  Each operator is a module
of its own; ``registry`` holds the thin queries over the standard tables and
their SQL.
"""
