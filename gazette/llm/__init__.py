"""Operators that prepare large text collections for training. Nothing outside this folder imports it."""
