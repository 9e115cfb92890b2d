"""Operators composed end to end."""
