"""Errors, history, lineage, reliability and catalogue of a project."""
