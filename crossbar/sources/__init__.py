"""Panels from wide frames and from the star-schema tables."""
