"""Preparation, indexes and search."""
