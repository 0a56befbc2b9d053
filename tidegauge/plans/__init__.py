"""Whole monitoring jobs composed from the operators."""
