"""Streaming extension: finished rows as they arrive."""
