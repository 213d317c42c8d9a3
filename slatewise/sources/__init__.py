"""Readers, writers and tracking tables."""
