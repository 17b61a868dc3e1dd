"""Sequence plans, packing and spans."""
