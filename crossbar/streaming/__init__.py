"""Recursive operators over live bars."""
