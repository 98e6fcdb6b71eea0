"""Operators for preparing language-model training data.

One module holds one operator; ``queries`` holds the thin queries that fix the
published contracts.  Nothing outside this subpackage imports it.
"""
