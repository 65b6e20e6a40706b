"""Operators over the purchase tables."""
