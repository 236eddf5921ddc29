"""Recognised items as they arrive."""
