"""Operators on training texts and records. Nothing outside this folder imports it."""
