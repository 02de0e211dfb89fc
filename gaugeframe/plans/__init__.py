"""Declared queries and their verification."""
