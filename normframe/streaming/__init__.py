"""Frozen parameters on streams."""
