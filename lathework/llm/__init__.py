"""Operators for building training corpora.

Nothing else in the library imports this package.  ``queries`` holds the
registered queries (``opN_<name>`` and ``pipeline``) and ``oracles`` their SQL.
"""
