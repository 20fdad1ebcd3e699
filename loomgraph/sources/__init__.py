"""Readers and link parsing."""
