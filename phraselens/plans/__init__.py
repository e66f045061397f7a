"""Operators composed into the three user-facing stages."""
