"""Readers, writers and keyed upserts."""
