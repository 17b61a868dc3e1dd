"""Resumable and stateful streams."""
