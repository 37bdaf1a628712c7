"""Operators over triple tables and the records derived from them."""
