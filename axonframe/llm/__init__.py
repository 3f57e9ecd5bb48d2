"""Operators of a training-data pipeline: archives, tokens, near copies, filters and mixtures.

Nothing else in the library imports this subpackage.
"""
