"""Operators that prepare message and document collections for training; nothing outside this package imports it."""
