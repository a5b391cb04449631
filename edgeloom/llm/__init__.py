"""Operators for building language-model training data.

Nothing else in the package imports this one, so it can be deleted whole.
"""
