"""Whole reports, chained from the operators."""
