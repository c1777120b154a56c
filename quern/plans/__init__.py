"""Queries over the operators."""
