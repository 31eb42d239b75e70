"""Operators that a training-data pipeline needs, beside the ride engine.

Nothing else in the library imports this subpackage.
"""
