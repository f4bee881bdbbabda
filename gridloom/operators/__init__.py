"""Operators on matrices."""
