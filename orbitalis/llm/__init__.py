"""Operators for building language-model training corpora.

Nothing outside this subpackage imports it.  Each module holds one operator
with its general interface; ``catalog`` holds the thin queries over them.
"""
