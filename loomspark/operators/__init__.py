"""Materialisation, statements, data tests and analytics."""
