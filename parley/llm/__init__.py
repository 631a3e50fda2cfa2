"""Operators for training-data pipelines; nothing outside this folder imports them."""
