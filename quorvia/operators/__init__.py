"""Operators over survey distributions and predictions."""
