"""Readers, dictionaries and writers."""
