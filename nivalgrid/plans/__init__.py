"""Composite analyses assembled from operators."""
