"""Operators that prepare text for training; nothing outside this subpackage imports it."""
