"""Whole conversions, put together from the operators."""
