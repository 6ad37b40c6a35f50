"""Operators for building text training data.

Each module holds one operator with its own general interface; ``queries``
registers the thin ``opN_<name>`` queries.  Nothing else in the library
imports this subpackage.
"""
