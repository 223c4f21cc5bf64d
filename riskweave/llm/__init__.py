"""Operators for preparing training text; each works on any documents-like DataFrame."""
