"""Readers of what recognition left behind."""
