"""Terrain operators: DataFrame in, DataFrame out."""
