"""Operators over arriving rows."""
