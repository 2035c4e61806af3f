"""Tidemark sources."""
