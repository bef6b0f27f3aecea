"""Reads documents and schemas."""
