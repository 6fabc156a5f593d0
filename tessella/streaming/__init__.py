"""Splitting data that keeps arriving."""
