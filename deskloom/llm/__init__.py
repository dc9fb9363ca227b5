"""Operators for building training data from documents; nothing else in the package imports them."""
