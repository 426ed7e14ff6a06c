"""Readers, contracts and writers."""
