"""Whole jobs assembled from the operators."""
