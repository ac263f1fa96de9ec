"""Operators on language-model texts; nothing outside this package imports it."""
