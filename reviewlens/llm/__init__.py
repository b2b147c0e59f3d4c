"""Operators of a training-data pipeline over ``documents``, ``benchmark``, ``labels``
and ``conversations``.  Nothing outside this package imports it."""
