"""Operators for large training-text pipelines. Nothing outside this subpackage imports it."""
