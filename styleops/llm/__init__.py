"""Operators for large training-data tables; nothing else in the library imports this package."""
