"""Queries bound to the driver tables, each with its SQL twin."""
