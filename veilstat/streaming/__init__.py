"""Releases over micro-batches, under a budget."""
