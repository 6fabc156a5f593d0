"""Operators over multi-label frames."""
