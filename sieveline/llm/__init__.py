"""Operators for training-data pipelines.

Nothing else in the library imports this subpackage.  ``queries`` holds the
thin ``opN_<name>`` queries, every other module one operator with its own
general interface.
"""
