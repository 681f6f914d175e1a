"""Operators that prepare text for language-model training.

Nothing else in the library imports this subpackage; ``queries`` holds the
registered queries and ``oracles`` their SQL.
"""
