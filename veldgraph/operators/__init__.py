"""Operators over catalogs and object tables."""
