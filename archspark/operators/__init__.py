"""Operators on the tables of a source tree."""
