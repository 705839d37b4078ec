"""Readers and reference dimensions."""
