"""Tidemark plans."""
