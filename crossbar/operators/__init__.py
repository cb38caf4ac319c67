"""Operators over one bar, over a name's history, over pairs of names and over matrices."""
