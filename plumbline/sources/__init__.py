"""Plumbline sources."""
