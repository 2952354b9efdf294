"""Operators for large-scale training-data preparation.

Each module holds one operator with its own general interface; ``queries`` derives the
contract columns of the ``opN_*`` queries from them.  Nothing outside this subpackage
imports it.
"""
