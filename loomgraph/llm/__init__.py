"""Operators for text and model data. Nothing outside this subpackage imports it."""
