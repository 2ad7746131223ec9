"""Operators for preparing training text and vectors; nothing outside this folder imports it."""
