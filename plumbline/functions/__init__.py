"""Plumbline functions."""
