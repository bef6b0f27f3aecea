"""Scalar and array expressions: text, codec, stop words."""
