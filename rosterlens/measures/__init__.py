"""Measure catalogue: named aggregates evaluated over any grouping."""
