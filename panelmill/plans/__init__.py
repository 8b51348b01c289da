"""Whole stages built out of the operators."""
