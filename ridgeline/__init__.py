"""Ridgeline: raster terrain analytics as Spark DataFrame transformations."""
