"""Readers, writers and stage snapshots."""
