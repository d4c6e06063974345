"""Operators for large text corpora; nothing outside this subpackage imports it."""
