"""Queries put together from the operators, with their SQL."""
