"""Operators over impression tables, one module per concern."""
