"""Operators for preparing text corpora. Nothing else in the library imports this subpackage."""
