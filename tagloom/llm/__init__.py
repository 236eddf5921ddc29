"""Operators for training data: survivors, copies, packing, leaks and spam."""
