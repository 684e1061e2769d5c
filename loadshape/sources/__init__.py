"""Readers with schema mapping, and writers."""
