"""Operators for training data. Nothing else in the package imports this one."""
