"""Operators for preparing training text and media.  Nothing outside this subpackage imports it."""
