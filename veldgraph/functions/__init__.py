"""Scalar functions: query expressions, JSON values and terms as columns."""
