"""Operators for preparing language-model training data.

Each module holds one operator with a general interface; ``queries`` applies them to the
driver's tables.  Nothing else in the library imports this subpackage.
"""
