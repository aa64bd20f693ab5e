"""Operators for preparing training data, each on DataFrames of documents or pages.

Nothing else in the library imports this subpackage.
"""
