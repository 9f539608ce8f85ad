"""Operators for training-data corpora, each a DataFrame job over documents or pages.

Nothing else in the library imports this subpackage.
"""
