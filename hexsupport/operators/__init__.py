"""Operators on cell sets, polygons and source tables."""
