"""Operators for large training-text corpora.

Each module holds one operator with its own general interface; ``queries``
registers the thin ``opN_<name>`` queries over the given tables and
``oracle`` their SQL.  Nothing else in the package imports this folder.
"""
