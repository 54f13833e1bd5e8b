"""Whole jobs and reports put together from the operators."""
